"""Ids of a public byte-level BPE tokenizer, with a cache of words.

No pre-token of the tokenizer's pattern reaches over a space or line break into the next word: a single
space belongs to the word after it and a line break between two words stands alone. A text whose white
space is only such single characters is thus a list of words whose ids can be looked up one by one. Any
other text is parted by the pattern itself.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import regex

SPECIAL = "<|endoftext|>"
#: The pre-token pattern of the byte-level tokenizers (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MOST_WORDS = 400_000


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Ids:
    """``Ids(path)(texts)``: for each text its ids as little-endian unsigned 32-bit numbers.

    The tokenizer's special string is its own id, or ordinary text if ``special_as_text``.
    """

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts = regex.compile(PATTERN)
        self.known: dict[str, bytes] = {}
        self.tokenizer.encode_special_tokens = special_as_text
        special = None if special_as_text else self.tokenizer.token_to_id(SPECIAL)
        self.special = None if special is None else np.uint32(special).tobytes()
        self.encode = ranked(path) or (lambda piece: self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def words(self, text: str) -> list[str]:
        """Pieces whose ids, one after the other, are the text's ids."""
        if "\0" in text or text.split() != text.replace("\n", " ").split(" "):
            return self.parts.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def learn(self, words: set[str]) -> None:
        encode, known = self.encode, self.known
        for w in words:
            known[w] = array("I", encode(w)).tobytes()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        parted = [self.words(t) if t and not (self.special and SPECIAL in t) else [] for t in texts]
        if new := {w for words in parted for w in words if w not in self.known}:
            self.learn(new)
        return [
            self.special.join(self(text.split(SPECIAL))) if not words and text else b"".join([self.known[w] for w in words])
            for text, words in zip(texts, parted, strict=True)
        ]


def ranked(path: str):
    """A quicker encoder of the same ids, for a file whose merges stand in the order of the ids they make; else None.

    Merging the pair of the lowest id first is then the same as merging by the list. Every token of the vocabulary that
    is text has been compared with the file's own encoder, as have whole documents in the tests.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab.get(a + b, -1) for a, b in merges]
    if any(x >= y for x, y in zip(made, made[1:])) or min(made) < 0:
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if all(c in byte for c in token) and token != SPECIAL}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
