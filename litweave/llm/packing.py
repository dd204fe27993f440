"""Best-two-fit packing of documents into token sequences.

The plan needs only how many pieces there are of each length, at most ``size`` numbers, so it is made on
the driver at any corpus size: a bin is filled greedily with the largest lengths that fit; then its smallest
piece is replaced by the two unpacked ones that fill the gap it would leave most tightly, if they fill more and
neither is smaller than half of it.
As long as the lengths a bin used last, the next bins come out alike, so bins are planned in runs: a few
thousand patterns with counts. Pieces of one length are interchangeable; each takes the place
that its rank among them has in the plan.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, portions
from .tokens import Ids, public_path

SIZE = 1024
END = 2
PER_SALT = 1_000


def best_two(left: np.ndarray, room: int, small: int) -> tuple[int, int] | None:
    """The two lengths still there whose sum is the largest that is over ``small`` and at most ``room``; each at least half of ``small``."""
    have = np.flatnonzero(left[: room + 1])
    have = have[2 * have >= small]
    best, found, j = small, None, len(have) - 1
    for i in have.tolist():
        while j >= 0 and have[j] + i > room:
            j -= 1
        if j < 0 or have[j] < i:
            break
        k = int(have[j])
        if k == i and left[i] < 2:
            if j == 0 or (k := int(have[j - 1])) < i:
                continue
        if k + i > small and k + i >= best:  # of equal sums the one of the most equal parts: small pieces fill later gaps
            best, found = k + i, (i, k)
    return found


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a bin, number of such bins)] that holds every piece once.

    The two pieces that replace a bin's smallest one are each at least half of it: smaller ones are
    left for gaps that nothing else fits, as a bin that takes two small pieces early leaves a bin open later.
    """
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    out = []
    while left.any():
        items: list[int] = []
        gap = size
        while gap:
            have = np.flatnonzero(left[1 : gap + 1])
            if not len(have):
                break
            top = int(have[-1]) + 1
            n = min(int(left[top]), gap // top)
            items += [top] * n
            left[top] -= n
            gap -= n * top
        if gap and len(items) > 1 and (two := best_two(left, gap + items[-1], items[-1])):
            left[items[-1]] += 1
            items[-1:] = sorted(two, reverse=True)
            for x in two:
                left[x] -= 1
        used = Counter(items)
        more = min(int(left[x]) // m for x, m in used.items())
        for x, m in used.items():
            left[x] -= more * m
        out.append((tuple(items), more + 1))
    return out


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Length → (first rank, first sequence, pieces in a bin, first offset, step) of each pattern that has it."""
    rows: dict[int, list] = {}
    taken: Counter = Counter()
    sequence = 0
    for items, n in patterns:
        offset = 0
        for x, m in Counter(sorted(items, reverse=True)).items():
            rows.setdefault(x, []).append((taken[x], sequence, m, offset))
            taken[x] += m * n
            offset += m * x
        sequence += n
    return {x: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for x, r in rows.items()}


def cut_points(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, but for the first."""
    first = n % size or size
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


def pieces(docs: DataFrame, tokenizer_path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids with ``end`` after them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, last = Ids(tokenizer_path or public_path()), np.array([end], "<u4").tobytes()
        for pdf in portions(batches):
            out = []
            for doc_id, raw in zip(pdf["doc_id"].array, ids([t if isinstance(t, str) else None for t in pdf["text"]]), strict=True):
                raw += last
                for k, (s, n) in enumerate(cut_points(len(raw) // 4, size)):
                    out.append((doc_id, k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, tokenizer_path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """Per piece of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the one token ``end``. Rows that share an id, and those without one, are packed each for
    itself. Texts of any length are encoded whole; only documents of more than ``size`` tokens are cut, into pieces of
    ``size`` of which the first may be shorter. Further columns are not read. An empty table gives an empty result.
    The tokenizer's file is looked up where it is read, on the executors.
    """
    p = cut(pieces(docs, tokenizer_path, size, end))
    counts = {r["length"]: r["n"] for r in p.groupBy("length").agg(F.count("*").alias("n")).collect()}
    at = places(plan(counts, size))
    # a length has salts in proportion to its pieces, so that there are at most size + pieces / PER_SALT of (length, salt)
    salts = F.array(*[F.lit(1 + counts.get(n, 0) // PER_SALT) for n in range(size + 1)])
    p = p.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.get(salts, F.col("length").cast("int"))))
    before = p.groupBy("length", "salt").agg(F.count("*").alias("n"))
    w = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = cut(before.select("length", "salt", (F.sum("n").over(w) - F.col("n")).alias("before")))
    own = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = p.withColumn("own", F.row_number().over(own) - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            seq, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for x in np.unique(length).tolist():
                own = np.flatnonzero(length == x)
                first, sequence, m, offset = at[x]
                k = np.searchsorted(first, rank[own], "right") - 1
                q = rank[own] - first[k]
                seq[own], off[own] = sequence[k] + q // m[k], offset[k] + q % m[k] * x
            pdf = pdf.assign(sequence_id=seq, offset=off)
            yield pdf[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]].astype({"doc_id": "Int64"})

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
