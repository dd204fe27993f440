"""Edit-aware token counts: a tree of pre-token segments per document.

A leaf is a run of whole pre-tokens with its numbers of characters and of tokens; inner nodes hold sums. An edit
re-reads the leaves that it touches with the context that can matter: a pre-token's match looks at most two characters
beyond its end, so leaves that end two characters before the edit stand, and as a match depends on
nothing before its start, all stands again from the first old leaf border after the edit that is a border of the new
pre-tokens too. Each new pre-token is a leaf of its own. If they are no more than the leaves they replace, they take
these leaves' places, leaves that are left over become empty, and only the sums above are set anew. Otherwise, and when
more than half of all leaves are empty, the inner nodes are built again from the leaves' counts, with
nothing encoded again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import portions
from .tokens import Ids, public_path

LOOK = 2


class Counts(dict):
    """Piece of text → its number of tokens."""

    def __init__(self, ids: Ids) -> None:
        self.ids = ids

    def __missing__(self, piece: str) -> int:
        if len(self) > 400_000:
            self.clear()
        n = self[piece] = len(self.ids.encode(piece))
        return n


class TokenTree:
    def __init__(self, pieces: list[str], counts: Counts) -> None:
        self.counts = counts
        self._fill(pieces)

    def _fill(self, pieces: list[str]) -> None:
        self.leaf = pieces or [""]
        n = len(self.leaf)
        own = np.zeros((n, 2), np.int64)
        own[:, 0] = np.fromiter(map(len, self.leaf), np.int64, n)
        own[:, 1] = np.fromiter(map(self.counts.__getitem__, self.leaf), np.int64, n) if pieces else 0
        self._build(own)

    def _build(self, own: np.ndarray) -> None:
        """The sums over the leaves' characters and tokens."""
        level = np.zeros((1 << max(0, (len(own) - 1).bit_length()), 2), np.int64)
        level[: len(own)] = own
        self.levels = [level]
        while len(level) > 1:
            level = level[0::2] + level[1::2]
            self.levels.append(level)
        self.spare = 0

    @property
    def chars(self) -> int:
        return int(self.levels[-1][0, 0])

    @property
    def tokens(self) -> int:
        return int(self.levels[-1][0, 1])

    def find(self, position: int) -> tuple[int, int]:
        """(leaf, its first character's position) of the leaf that holds a character."""
        at, start = 0, 0
        for level in reversed(self.levels[:-1]):
            at *= 2
            left = int(level[at, 0])
            if position - start >= left:
                start += left
                at += 1
        return at, start

    def _set(self, i: int, chars: int, tokens: int) -> None:
        change = np.array([chars, tokens]) - self.levels[0][i]
        for level in self.levels:
            level[i] += change
            i //= 2

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace characters [start, end), cut to the text's length, by ``new``; the number of pre-tokens read again."""
        total = self.chars
        start = min(max(start, 0), total)
        end = min(max(end, start), total)
        if not total:
            parts = self.counts.ids.parts.findall(new)
            self._fill(parts)
            return len(parts)
        first, at = self.find(max(0, start - LOOK))
        last, _ = self.find(min(end, total - 1))
        more = 4
        while True:
            stop = min(len(self.leaf), last + 1 + more)
            old = "".join(self.leaf[first:stop])
            text = old[: start - at] + new + old[end - at :]
            whole = stop == len(self.leaf)
            borders, p, shift = {}, at, len(new) - (end - start)
            for i in range(first, stop):
                p += len(self.leaf[i])
                if p >= end:
                    borders.setdefault(p - at + shift, i + 1)
            parts, done, to = [], 0, None
            for m in self.counts.ids.parts.finditer(text):
                if not whole and m.end() + LOOK > len(text):
                    break
                parts.append(m[0])
                done = m.end()
                if done >= start - at + len(new) and done in borders:
                    to = borders[done]
                    break
            if to is None and whole:
                to = len(self.leaf)
            if to is not None:
                break
            more *= 4
        had = sum(1 for x in self.leaf[first:to] if not x)
        own = [(len(x), self.counts[x]) for x in parts] + [(0, 0)] * (to - first - len(parts))
        if len(parts) <= to - first:
            self.leaf[first:to] = parts + [""] * (to - first - len(parts))
            for i, (chars, tokens) in enumerate(own, first):
                self._set(i, chars, tokens)
            self.spare += to - first - len(parts) - had
        else:
            level = np.concatenate([self.levels[0][:first], np.array(own, np.int64).reshape(-1, 2), self.levels[0][to : len(self.leaf)]])
            self.leaf[first:to] = parts
            self._build(level)
            self.spare = self.leaf.count("")
        if 2 * self.spare > len(self.leaf):
            some = [i for i, x in enumerate(self.leaf) if x] or [0]
            level = self.levels[0][some]
            self.leaf = [self.leaf[i] for i in some]
            self._build(level)
        return len(parts)

    def text(self) -> str:
        return "".join(self.leaf)


def edited_counts(docs: DataFrame, edits: str = "edits", tokenizer_path: str | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, and an array of (start, stop, text) edits): doc_id, n_chars, n_tokens, edited_chars, edited_tokens, pretokens_read.

    Edits apply one after the other, each in positions (code points) of the text that it finds; positions past the end
    are cut. A null text counts as empty, a null array as no edit, a null replacement as "". The
    tokenizer's special string is ordinary text. Rows that share an id are counted each for itself. Texts of any length are
    counted whole. Further columns are not read. An empty table gives an empty result. The tokenizer's file is
    looked up where it is read, on the executors.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = Ids(tokenizer_path or public_path(), special_as_text=True)
        counts = Counts(ids)
        for pdf in portions(batches):
            out = []
            parted = [ids.words(t) if isinstance(t, str) and t else [] for t in pdf["text"]]
            for doc_id, words, changes in zip(pdf["doc_id"].array, parted, pdf[edits], strict=True):
                tree = TokenTree(words, counts)
                before, again = (tree.chars, tree.tokens), 0
                for e in changes if changes is not None else ():
                    again += tree.edit(e["start"], e["stop"], e["text"] or "")
                out.append((doc_id, *before, tree.chars, tree.tokens, again))
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "n_tokens", "edited_chars", "edited_tokens", "pretokens_read"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text", edits).mapInPandas(run, "doc_id bigint, n_chars bigint, n_tokens bigint, edited_chars bigint, edited_tokens bigint, pretokens_read bigint")
