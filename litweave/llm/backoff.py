"""A smoothed trigram model as a weighted automaton with failure arcs, and the log-probability of every text under it.

The model. Counts c are those of the training fold. A token has (c - d) / N, and all unseen words together, which are one
class, d V / N; d is the share of words seen once, so that the class has about as much as such words. A history h has
``((c(hw) - D) + b P(w | h'))`` of its c(h) for a word w seen after it and ``b P(w | h')`` for others, b being what the
discounts leave and h' the history without its first word; D is estimated from the bigrams seen once and twice. Histories of one word are
states where they were seen, those of two words where they were seen twice and a word was seen after them twice, as trigrams count from ``LEAST`` on.

The automaton. A state is a history; an arc (state, word) has the log10 of P(word | history) and leads to the state of
the longest history then; a state without an arc for a word has a failure arc to the state of the shorter history, with
the log10 of its b. The root has an arc for every word. Texts are read once from left to right.

The work. Texts become blocks of about ``TOKENS`` tokens, each with its own vocabulary. A block asks for the counts of its
distinct bigrams, then, where both bigrams were seen twice, of its trigrams: it sends them, with its own counts, to buckets of
whole histories, which add up the blocks' counts and answer each. From the answers a block builds the part of the
automaton that its texts can meet, and reads them. So no model is held whole anywhere, and what is exchanged grows with the text. Histories that
are so frequent that they would fill a bucket are spread over several by their next word; these
are found by their counts, fewer than 2 / ``LEAST_SHARE``, and only their sums go through the driver. Within a bucket histories are told apart by 48 bits of
hash, beside those that chose the bucket, and the words after a history by 40.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cut, cut_by, portions
from .labelled import fold
from .minhash import WordHashes, mixed

FOLDS, HELD_OUT = 7, 2
#: Tokens of a block, n-grams of a bucket, tokens of a stretch that is read in step with others, and bytes that are parted at once.
TOKENS, PER_BUCKET, STRETCH, BYTES = 1 << 20, 1 << 19, 256, 1 << 22
#: A history is spread over buckets from this share of all tokens on, or from PER_BUCKET tokens on where that is more.
LEAST_SHARE = 2e-6
#: Fewest occurrences that count, of bigrams and of trigrams; bounds of the discounts.
LEAST, DISCOUNTS = {2: 1, 3: 2}, (0.1, 0.9)
END = xxhash.xxh3_64_intdigest(b" end")  # no word has a space
SPACE = re.compile(rb"[ \t-\r]")
#: Bytes of a history's and of a word's hash that are exchanged.
CTX, WORD = 6, 5
_CTX = np.uint64((1 << 8 * CTX) - 1)
_STEP, _SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
BLOCKS = "block bigint, held boolean, tokens bigint, pieces array<struct<row bigint, doc_id bigint>>, lengths binary, leads binary, words binary, at binary"
ASKED = "bucket bigint, block bigint, held boolean, ctx binary, sizes binary, words binary, n binary, spread binary"
ANSWERS = "step int, bucket bigint, block bigint, c binary, spread binary, followers binary, total binary, ctx binary, types bigint, single bigint, tokens bigint, once bigint, twice bigint"
SUMS = ["types", "single", "tokens", "once", "twice"]
SCORES = "row bigint, doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def packed(a: np.ndarray) -> bytes:
    """Whole numbers from 0 in the fewest bytes; nothing where all are 1."""
    if (a == 1).all():
        return b""
    size = next(k for k in (1, 2, 4, 8) if int(a.max(initial=0)) < 1 << 8 * k)
    return bytes([size]) + a.astype(f"u{size}").tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{raw[0]}", offset=1).astype(np.int64) if raw else np.ones(n, np.int64)


def planes(a: np.ndarray, size: int) -> bytes:
    """The lowest ``size`` bytes of 64-bit numbers, all first bytes, then all second ones, and so on."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def joined(raw: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(size, -1).T
    return out.view("<u8").reshape(-1)


class Few:
    """Numbers by a few 64-bit keys."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray) -> None:
        self.keys, first = np.unique(keys, return_inverse=True)
        self.values = [np.bincount(first, v, len(self.keys)).astype(np.int64) for v in values]

    def put(self, keys: np.ndarray, *into: np.ndarray) -> None:
        """Writes the values of those of ``keys`` that are there over ``into``."""
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            own = self.keys[at] == keys
            for v, x in zip(self.values, into, strict=True):
                x[own] = v[at[own]]


def words_of(text: str) -> Iterator[list[bytes]]:
    """Lower-case words of a text, of some BYTES at once."""
    data, at = text.encode("utf-8", "surrogatepass").lower(), 0
    while at < len(data):
        gap = SPACE.search(data, at + BYTES)
        to = gap.start() if gap else len(data)
        yield data[at:to].split()
        at = to


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of texts (doc_id, text, held), of one fold each; a text of more than TOKENS tokens is in several, with the two tokens before each piece."""
    seen, task, blocks, rows = WordHashes(), TaskContext.get().partitionId() << 40, 0, 0
    pieces: dict[bool, list] = {False: [], True: []}

    def block(held: bool) -> pd.DataFrame:
        nonlocal blocks
        own = pieces[held]
        words, at, n = np.unique(np.concatenate([p[3] for p in own]), return_inverse=True, return_counts=True)
        order, rank = np.argsort(-n, kind="stable"), np.empty(len(n), np.int64)
        rank[order] = np.arange(len(n))  # frequent words have small numbers
        words, at = words[order], rank[at]
        lengths, leads = (np.array(x, np.uint32) for x in ([len(p[3]) for p in own], [p[2] for p in own]))
        out = (task + blocks, held, int(lengths.sum() - leads.sum()), [{"row": p[0], "doc_id": p[1]} for p in own], lengths.tobytes(), leads.tobytes(), words.tobytes(), planes(at, 3 if len(words) < 1 << 24 else 4))
        blocks += 1
        own.clear()
        return pd.DataFrame([out], columns=[c.split()[0] for c in BLOCKS.replace("row bigint, doc_id", "").split(", ")])

    held_back = {False: 0, True: 0}
    for pdf in portions(batches):
        for doc_id, text, held in zip(pdf["doc_id"].array, pdf["text"].array, pdf["held"].tolist(), strict=True):
            parts = [np.fromiter(map(seen.__getitem__, w), np.uint64, len(w)) for w in words_of(text)] if isinstance(text, str) else []
            h = np.concatenate([np.array([END], np.uint64), *parts, np.array([END], np.uint64)])
            for at in range(1, len(h), TOKENS):
                lead = min(at, 2)
                piece = h[at - lead : at + TOKENS]
                if held_back[held] and held_back[held] + len(piece) > TOKENS:
                    yield block(held)
                    held_back[held] = 0
                pieces[held].append((task + rows, None if pd.isna(doc_id) else int(doc_id), lead, piece))
                held_back[held] += len(piece)
            rows += 1
    for held in (False, True):
        if pieces[held]:
            yield block(held)


class Block:
    """A block's tokens, and its distinct bigrams."""

    def __init__(self, r) -> None:
        self.id, self.held, self.words = int(r.block), bool(r.held), np.frombuffer(r.words, np.uint64)
        self.lengths, self.leads = np.frombuffer(r.lengths, np.uint32).astype(np.int64), np.frombuffer(r.leads, np.uint32).astype(np.int64)
        self.at = joined(r.at, len(r.at) // int(self.lengths.sum())).astype(np.int64)
        self.starts = self.lengths.cumsum() - self.lengths
        #: The place of each token in its piece; those before the lead are of the piece before.
        self.place = np.arange(len(self.at)) - np.repeat(self.starts, self.lengths)
        self.own = self.place >= np.repeat(self.leads, self.lengths)
        width = len(self.words)
        self.after = np.flatnonzero(self.place >= 1)
        pairs, self.pair = np.unique(self.at[self.after - 1] * width + self.at[self.after], return_inverse=True)
        self.first, self.last = pairs // width, pairs % width
        self.n = np.bincount(self.pair, self.own[self.after], len(pairs)).astype(np.int64)

    def trigrams(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pair before, its next word, pair that the two last words are, number) of trigrams of bigrams seen twice; ``c`` has the bigrams' counts.

        A pair that is followed by a word that makes no such bigram has one entry for all of these, of the word after the last.
        """
        width = len(self.words) + 1
        pair = np.full(len(self.at), -1)
        pair[self.after] = self.pair
        at = np.flatnonzero(self.place >= 2)
        at = at[c[pair[at - 1]] >= LEAST[3]]
        can = c[pair[at]] >= LEAST[3]
        keys, where, of = np.unique(pair[at - 1] * width + np.where(can, self.at[at], width - 1), return_index=True, return_inverse=True)
        return keys // width, keys % width, pair[at[where]], np.bincount(of, can, len(keys)).astype(np.int64)


class Question:
    """Distinct n-grams of a block, by history (its number and hash) and word hash, in the order in which they are asked and answered.

    Those that are not ``real`` ask for their history alone.
    """

    def __init__(self, history: np.ndarray, ctx: np.ndarray, words: np.ndarray, spread: np.ndarray, real: np.ndarray, buckets: int) -> None:
        salt = mixed(words ^ _SALT) % spread.astype(np.uint64)
        bucket = ((mixed(ctx) + salt * _SALT) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, history = bucket[order], history[order]
        new = np.diff(bucket, prepend=-1) != 0
        self.n, starts = len(order), np.flatnonzero(new)
        self.runs = np.flatnonzero(new | (np.diff(history, prepend=-1) != 0))
        self.history, self.ctx, self.spread = history[self.runs], ctx[order][self.runs], spread[order][self.runs]
        real = real[order]
        self.order = order[real]
        self.words = words[self.order]
        count = lambda at: np.add.reduceat(real.astype(np.int64), at) if len(at) else np.empty(0, np.int64)
        self.sizes, self.buckets = count(self.runs), bucket[starts]
        self.grams, self.of_bucket = np.append(0, count(starts).cumsum()), np.searchsorted(self.runs, np.append(starts, self.n))

    def rows(self, block: Block, n: np.ndarray) -> pd.DataFrame:
        n, out = n[self.order], []
        for i, bucket in enumerate(self.buckets.tolist()):
            own, grams = slice(*self.of_bucket[i : i + 2]), slice(*self.grams[i : i + 2])
            out.append((bucket, block.id, block.held, planes(self.ctx[own], CTX), packed(self.sizes[own]), planes(self.words[grams], WORD), packed(n[grams]), packed(self.spread[own])))
        return pd.DataFrame(out, columns=[c.split()[0] for c in ASKED.split(", ")])

    def answered(self, rows: pd.DataFrame, histories: int, hot: Few, ctx: np.ndarray) -> tuple[np.ndarray, ...]:
        """(counts, buckets to spread over) of the n-grams and (words seen after, total) of ``histories`` (hashes ``ctx``)."""
        rows = rows.sort_values("bucket")
        n, runs = np.diff(self.grams), np.diff(self.of_bucket)
        c, spread, followers, total = (
            np.concatenate([np.empty(0, np.int64), *map(unpacked, rows[k], size)]) for k, size in (("c", n), ("spread", n), ("followers", runs), ("total", runs))
        )
        of_gram, of_history = np.zeros((2, self.n), np.int64), np.zeros((2, histories), np.int64)
        of_gram[:, self.order], of_history[:, self.history] = (c, spread), (followers, total)
        wide = self.history[self.spread > 1]
        sums = of_history[:, wide]
        hot.put(ctx[wide] & _CTX, *sums)
        of_history[:, wide] = sums
        return *of_gram, *of_history


def adder(step: int, many: float) -> Callable:
    """Adds up what the blocks ask of one bucket, and answers; n-grams of ``many`` occurrences are histories to spread."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ctx, words = [joined(x, CTX) for x in pdf["ctx"]], [joined(x, WORD) for x in pdf["words"]]
        histories, lengths = np.concatenate(ctx), np.array([len(w) for w in words])
        sizes = np.concatenate([unpacked(x, len(c)) for x, c in zip(pdf["sizes"], ctx, strict=True)])
        spread = np.concatenate([unpacked(x, len(c)) for x, c in zip(pdf["spread"], ctx, strict=True)])
        n = np.concatenate([unpacked(x, len(w)) for x, w in zip(pdf["n"], words, strict=True)])
        of = np.repeat(histories, sizes)
        _, first, gram = np.unique(mixed(of * _STEP + np.concatenate(words)), return_index=True, return_inverse=True)
        seen = np.bincount(gram, n, len(first))
        c = np.bincount(gram, n * np.repeat(~pdf["held"].to_numpy(bool), lengths), len(first)).astype(np.int64)
        once, twice = int((c == 1).sum()), int((c == 2).sum())
        c[c < LEAST[step]] = 0
        own, place = np.unique(histories, return_inverse=True)
        at = np.searchsorted(own, of[first])
        followers, total = (np.bincount(at, x, len(own)).astype(np.int64) for x in (c > 0, c))
        wide = np.isin(own, histories[spread > 1])
        counts, over = c[gram], np.maximum(np.ceil(seen / many), 1).astype(np.int64)[gram]
        bucket, out, i, j = int(pdf["bucket"].iloc[0]), [], 0, 0
        for block, x, w in zip(pdf["block"].tolist(), ctx, words, strict=True):
            k, m = j + len(x), i + len(w)
            out.append((step, bucket, block, packed(counts[i:m]), packed(over[i:m]), packed(followers[place[j:k]]), packed(total[place[j:k]]), None, 0, 0, 0, 0, 0))
            i, j = m, k
        known = total[~wide]
        out.append((step, bucket, None, None, None, packed(followers[wide]), packed(total[wide]), own[wide].tobytes(), int((known > 0).sum()), int((known == 1).sum()), int(known.sum()), once, twice))
        return pd.DataFrame(out, columns=[c.split()[0] for c in ANSWERS.split(", ")])

    return run


def sums_of(answers: DataFrame) -> tuple[dict[str, int], Few]:
    """Sums of the buckets' own rows, and what histories in several buckets have in all, of which there are fewer than 2 / LEAST_SHARE."""
    own = answers.where("block is null")
    r = own.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS]).first().asDict()
    ctx, followers, total = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for x in own.where("length(ctx) > 0").select("ctx", "followers", "total").collect():
        ctx.append(np.frombuffer(bytes(x["ctx"]), np.uint64))
        followers.append(unpacked(bytes(x["followers"]), len(ctx[-1])))
        total.append(unpacked(bytes(x["total"]), len(ctx[-1])))
    hot = Few(np.concatenate(ctx), np.concatenate(followers), np.concatenate(total))
    return {**r, "types": r["types"] + int((hot.values[1] > 0).sum()), "tokens": r["tokens"] + int(hot.values[1].sum())}, hot


def hot_words(blocks: DataFrame, total: int, many: float) -> Few:
    """Words of at least ``many`` occurrences, and perhaps some of half as many, by the number of buckets that they are spread over.

    A block names the words that have a quarter of that share of its tokens or more.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw, at, tokens in zip(pdf["words"], pdf["at"], pdf["tokens"], strict=True):
                n = np.bincount(joined(at, 3 if len(raw) < 8 << 24 else 4).astype(np.int64), minlength=len(raw) // 8)
                often = n * 4 >= tokens * many / total
                yield pd.DataFrame({"h": np.frombuffer(raw, np.uint64)[often].astype(np.int64), "n": n[often]})

    found = blocks.select("words", "at", "tokens").mapInPandas(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= many / 2).collect()
    return Few(np.array([r["h"] for r in found], np.int64).astype(np.uint64), np.ceil(np.array([r["n"] for r in found], float) / many))


class Automaton:
    """States by number, 0 the root; arcs by (state, word); failure arcs."""

    def __init__(self, width: int, arcs: tuple[np.ndarray, np.ndarray, np.ndarray], root: tuple[np.ndarray, np.ndarray], fail: np.ndarray, back: np.ndarray) -> None:
        order = np.argsort(arcs[0])
        self.width, (self.keys, self.weight, self.to) = width, (x[order] for x in arcs)
        self.root, self.fail, self.back = root, fail, back

    def read(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state after, log10 of the probability) for each state and the word read in it."""
        weight, todo = np.zeros(len(state)), np.flatnonzero(state)
        state = state.copy()
        while len(todo):
            s, w = state[todo], word[todo]
            key = s * self.width + w
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            there, arc = todo[hit], at[hit]
            weight[there] += self.weight[arc]
            state[there] = -1 - self.to[arc]  # done: kept apart until all are
            todo, s = todo[~hit], s[~hit]
            weight[todo] += self.back[s]
            state[todo] = self.fail[s]
            todo = todo[state[todo] > 0]
        at_root = state == 0
        weight[at_root] += self.root[0][word[at_root]]
        return np.where(at_root, self.root[1][word], -1 - state), weight


class Model:
    """The numbers that all blocks share."""

    def __init__(self, sums: dict[str, int], hot: dict[int, Few], spread: Few, buckets: int) -> None:
        self.tokens, self.types, self.hot, self.spread, self.buckets = sums["tokens"], sums["types"], hot, spread, buckets
        self.d = float(np.clip(sums["single"] / max(self.types, 1), *DISCOUNTS))
        self.discount = float(np.clip(sums["once"] / max(sums["once"] + 2 * sums["twice"], 1), *DISCOUNTS))

    def unigrams(self, c: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(len(c))
        return np.where(c > 0, c - self.d, self.d * self.types) / self.tokens


def pairs_asked(b: Block, spread: Few, buckets: int) -> Question:
    over = np.ones(len(b.words), np.int64)
    spread.put(b.words, over)
    return Question(b.first, b.words[b.first], b.words[b.last], over[b.first], np.ones(len(b.n), bool), buckets)


def trigrams_asked(b: Block, before: np.ndarray, word: np.ndarray, spread: np.ndarray, buckets: int) -> tuple[Question, np.ndarray]:
    ctx = mixed(b.words[b.first] * _STEP + b.words[b.last])
    return Question(before, ctx[before], np.append(b.words, np.uint64(0))[word], spread[before], word < len(b.words), buckets), ctx


def automaton(b: Block, model: Model, answers: pd.DataFrame) -> tuple[Automaton, np.ndarray]:
    """The part of the automaton that a block's texts can meet, and the counts of its words."""
    width = len(b.words)
    c2, spread, followers, c1 = pairs_asked(b, model.spread, model.buckets).answered(answers[answers["step"] == 2], width, model.hot[2], b.words)
    before, word, last, _ = b.trigrams(c2)
    asked, ctx = trigrams_asked(b, before, word, spread, model.buckets)
    c3, _, followers3, total3 = asked.answered(answers[answers["step"] == 3], len(c2), model.hot[3], ctx)

    p1 = model.unigrams(c1)
    back1 = model.discount * followers / np.maximum(c1, 1)
    p2 = np.maximum(c2 - model.discount, 0) / np.maximum(c1, 1)[b.first] + back1[b.first] * p1[b.last]
    back2 = (c2 - total3 + model.discount * followers3) / np.maximum(c2, 1)
    p3 = np.maximum(c3 - model.discount, 0) / np.maximum(c2, 1)[before] + back2[before] * p2[last]

    single = np.where(followers > 0, 1 + np.arange(width), 0)
    double = np.where(followers3 > 0, width + followers3.astype(bool).cumsum(), 0)
    after = np.where(double > 0, double, single[b.last])
    fail, back = np.zeros(1 + width + int((double > 0).sum()), np.int64), np.zeros(1 + width + int((double > 0).sum()))
    fail[double[double > 0]] = single[b.last[double > 0]]
    back[1 : 1 + width], back[double[double > 0]] = np.log10(np.maximum(back1, 1e-300)), np.log10(back2[double > 0])
    two, three = c2 > 0, c3 > 0
    keys = np.concatenate([single[b.first[two]] * width + b.last[two], double[before[three]] * width + word[three]])
    weights = np.log10(np.concatenate([p2[two], p3[three]]))
    return Automaton(width, (keys, weights, np.concatenate([after[two], after[last[three]]])), (np.log10(p1), single), fail, back), c1


def read(b: Block, a: Automaton) -> np.ndarray:
    """The log10 of the probability of each of a block's pieces: stretches of STRETCH tokens are read in step, each from the two tokens before it on."""
    counts = -(-(b.lengths - b.leads) // STRETCH)
    piece = np.repeat(np.arange(len(counts)), counts)
    nth = np.arange(len(piece)) - np.repeat(counts.cumsum() - counts, counts)
    start = b.starts[piece] + b.leads[piece] + nth * STRETCH
    stop = np.minimum(start + STRETCH, (b.starts + b.lengths)[piece])
    begin = np.maximum(start - 2, b.starts[piece])
    order = np.argsort(begin - stop, kind="stable")
    begin, start, stop, piece = begin[order], start[order], stop[order], piece[order]
    state, total, lengths = np.zeros(len(piece), np.int64), np.zeros(len(piece)), stop - begin
    live = len(piece)
    for k in range(int(lengths.max(initial=0))):
        while live and lengths[live - 1] <= k:
            live -= 1
        state[:live], weight = a.read(state[:live], b.at[begin[:live] + k])
        total[:live] += np.where(begin[:live] + k >= start[:live], weight, 0)
    return np.bincount(piece, total, len(counts))


def scored(pieces: list, b: Block, model: Model, answers: pd.DataFrame) -> pd.DataFrame:
    a, c = automaton(b, model, answers)
    of, own = np.repeat(np.arange(len(b.lengths)), b.lengths)[b.own], b.at[b.own]
    base = np.log10((c + 1) / (model.tokens + model.types + 1))
    count = lambda w=None: np.bincount(of, w, len(b.lengths))
    return pd.DataFrame({
        "row": [p["row"] for p in pieces], "doc_id": pd.array([p["doc_id"] for p in pieces], "Int64"), "n_tokens": count().astype(np.int64),
        "n_known": count(c[own] > 0).astype(np.int64), "base_score": count(base[own]), "score": read(b, a),
    })


def log_probabilities(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text is empty and has its end alone. Rows that share an id are scored each for itself; a null id is in no fold held
    out. Without training texts a text has probability 1, as all words are then the one unseen class. Texts of any length are
    read whole. Further columns are not read. An empty table gives an empty result.
    """
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    blocks = cut_by(docs.select("doc_id", "text", held.alias("held")).mapInPandas(_blocks, BLOCKS), "block")
    total = blocks.agg(F.sum("tokens")).first()[0] or 0
    many = max(PER_BUCKET, LEAST_SHARE * total)
    buckets = max(1, -(-total // PER_BUCKET))
    spread = hot_words(blocks, total, many) if total else Few(np.empty(0, np.uint64), np.empty(0))
    share = docs.sparkSession.sparkContext.broadcast

    def ask_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                b = Block(r)
                yield pairs_asked(b, spread, buckets).rows(b, b.n)

    two = Cut(blocks.mapInPandas(ask_pairs, ASKED).groupBy("bucket").applyInPandas(adder(2, many), ANSWERS)).df
    sums, hot2 = sums_of(two)
    shared = share((spread, hot2))

    def ask_trigrams(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        words, hot = shared.value
        b = Block(next(block.itertuples()))
        c, over, *_ = pairs_asked(b, words, buckets).answered(answers, len(b.words), hot, b.words)
        before, word, _, n = b.trigrams(c)
        return trigrams_asked(b, before, word, over, buckets)[0].rows(b, n)

    by_block = blocks.groupBy("block")
    asked = by_block.cogroup(two.where("block is not null").groupBy("block")).applyInPandas(ask_trigrams, ASKED)
    three = Cut(asked.groupBy("bucket").applyInPandas(adder(3, many), ANSWERS)).df
    model = share(Model(sums, {2: hot2, 3: sums_of(three)[1]}, spread, buckets))

    def score(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        r = next(block.itertuples())
        return scored(r.pieces, Block(r), model.value, answers)

    answers = two.unionByName(three).where("block is not null").select("step", "bucket", "block", "c", "spread", "followers", "total")
    s = by_block.cogroup(answers.groupBy("block")).applyInPandas(score, SCORES)
    s = s.groupBy("row", "doc_id").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return s.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(sums["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
