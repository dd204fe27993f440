"""How far apart the sources of a language are in their words, by pairs of sources and by terms of a source.

Terms are counted once per source within each task before anything is shuffled. A kept term is a sparse vector of counts
by source; terms of equal vectors are evaluated together. A pair of sources differs from the value it would have if
neither had any term only in vectors that one of them is in, so each distinct vector is evaluated for the pairs it touches, times
its number of terms, and added to the number of terms times the value of two zeros. For the ranks of terms a vector brings its
``RANKS`` smallest terms, as no other can be among the first, and of vectors that order the same the ones of smaller terms.
All numbers are integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, portions

#: Documents of its language that a term must be in; terms that are ranked for each source.
LEAST_DOCS, RANKS = 3, 200
UNIT = 1_000_000_000
#: Terms of a task that are counted before they are handed on; cells that a task evaluates, or sums, at once.
TERMS_HELD, CELLS = 400_000, 2_000_000
#: Bytes of ASCII that are not letters part terms; only A to Z change their case.
LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LETTERS).split()


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Occurrences and documents of every (lang, source, term), added up while there is room."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def rows() -> Iterator[pd.DataFrame]:
        for (lang, source), (n, docs) in held.items():
            if not n:
                continue
            yield pd.DataFrame({"lang": [lang] * len(n), "source": [source] * len(n), "term": [t.decode("utf-8", "surrogatepass") for t in n], "n": list(n.values()), "docs": [docs[t] for t in n]})
        held.clear()

    for pdf in portions(batches):
        for text, key in zip(pdf["text"], zip(pdf["lang"], pdf["source"], strict=True), strict=True):
            n, docs = held.setdefault(key, (Counter(), Counter()))
            own, size = terms(text), size - len(n)
            n.update(own)
            docs.update(set(own))
            size += len(n)
            if size > TERMS_HELD:
                yield from rows()
                size = 0
    yield from rows()


def source_counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, source, sid) of every group, and (lang, term, vec) of every kept term: its counts as sorted (sid, n)."""
    d = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    groups = cut(d.select("lang", "source").distinct().withColumn("sid", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1))
    by_source = d.mapInPandas(_counts, COUNTS).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # as every pair of sources of a language is in the result, sources are few: their table is smaller than the root of the result
    found = by_source.join(F.broadcast(groups), ["lang", "source"])
    vectors = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("sid", "n"))).alias("vec"))
    return groups, cut(vectors.where(F.col("docs") >= LEAST_DOCS).select("lang", "term", "vec"))


def share(n: str, of: str) -> Column:
    """1 + floor(UNIT * (n + 1) / of), exactly."""
    return F.expr(f"1 + (cast({UNIT} as decimal(10,0)) * cast({n} + 1 as decimal(19,0))) div cast({of} as decimal(19,0))")


def apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def shares(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    """``share`` of arrays, by long division in three digits of a thousand."""
    rest = n + 1
    out = rest // of
    rest = rest % of
    for _ in range(3):
        out = out * 1_000 + rest * 1_000 // of
        rest = rest * 1_000 % of
    return out + 1


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class PairSums:
    """Sums over vectors of one language, by (a, b): what their value has beyond that of two zeros."""

    def __init__(self, lang: str, of: np.ndarray) -> None:
        self.lang, self.of, self.zero = lang, of, shares(np.zeros(len(of), np.int64), of)
        self.rows: dict[tuple[bool, int], np.ndarray] = {}

    def add(self, sids: list[np.ndarray], ns: list[np.ndarray], times: np.ndarray) -> Iterator[pd.DataFrame]:
        lengths = np.fromiter(map(len, sids), np.int64, len(sids))
        ends, at = lengths.cumsum(), 0
        room = max(1, CELLS // len(self.of))
        while at < len(sids):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + room, "right")))
            self._add(np.repeat(np.arange(to - at), lengths[at:to]), np.concatenate(sids[at:to]), np.concatenate(ns[at:to]), times[at:to])
            at = to
            if len(self.rows) > room:
                yield from self.take()

    def _add(self, v: np.ndarray, sid: np.ndarray, n: np.ndarray, times: np.ndarray) -> None:
        p = np.tile(self.zero, (len(times), 1))
        p[v, sid] = shares(n, self.of[sid])
        inside = np.zeros(p.shape, bool)
        inside[v, sid] = True
        order = np.argsort(sid, kind="stable")
        v, sid = v[order], sid[order]
        own, others, zero = p[v, sid][:, None], p[v], self.zero[sid][:, None]
        starts = np.flatnonzero(np.diff(sid, prepend=-1))
        to = (gaps(own, others) - gaps(zero, self.zero[None, :])) * times[v][:, None]
        # pairs of two sources of the vector are counted from the first one's side
        back = np.where(inside[v], 0, gaps(others, own) - gaps(self.zero[None, :], zero)) * times[v][:, None]
        for first, x in ((True, to), (False, back)):
            for s, row in zip(sid[starts].tolist(), np.add.reduceat(x, starts, axis=0), strict=True):
                self.rows[first, s] = self.rows.get((first, s), 0) + row

    def take(self) -> Iterator[pd.DataFrame]:
        every = np.arange(len(self.of))
        for (first, s), row in self.rows.items():
            fixed = np.full(len(every), s)
            out = pd.DataFrame({"lang": [self.lang] * len(every), "a": fixed if first else every, "b": every if first else fixed, "more": row})
            yield out[out["more"] != 0]
        self.rows.clear()


def pair_sums(vectors: DataFrame, sizes: dict[str, np.ndarray]) -> DataFrame:
    """(lang, a, b, more) of distinct vectors (lang, vec, times); ``sizes`` has N + V of each source of a language."""
    shared = vectors.sparkSession.sparkContext.broadcast(sizes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, PairSums] = {}
        for pdf in batches:
            for lang, own in pdf.groupby("lang"):
                if lang not in sums:
                    sums[lang] = PairSums(lang, shared.value[lang])
                yield from sums[lang].add(own["sids"].tolist(), own["ns"].tolist(), own["times"].to_numpy())
        for s in sums.values():
            yield from s.take()

    v = vectors.select("lang", F.col("vec.sid").alias("sids"), F.col("vec.n").alias("ns"), "times")
    return v.mapInPandas(run, "lang string, a int, b int, more bigint").groupBy("lang", "a", "b").agg(F.sum(F.col("more").cast("decimal(38,0)")).alias("more"))


def divergence(docs: DataFrame) -> DataFrame:
    """Per source of ``docs`` (text, lang, source) and part: lang, source, part, item, value, rank.

    Null texts, languages and sources count as empty. ``pair`` has every other source of the language, ``term`` up to RANKS terms that the
    source has and that are commoner in it than in its language. Equal values stand by item. Rows that share an
    id, and repeated rows, are documents of their own; texts of any length are read whole. Further columns are not read. A source
    without kept terms has count 0 of each; a language without any gives pairs of value 0. An empty table gives an empty result.
    """
    groups, kept = source_counts(docs)
    sums = kept.select("lang", F.explode("vec").alias("x")).groupBy("lang", F.col("x.sid").alias("sid")).agg(F.sum("x.n").alias("size"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.expr("aggregate(vec, 0L, (s, x) -> s + x.n)")).alias("lang_size"))
    zero = F.lit(0).cast("long")
    g = groups.join(sums, ["lang", "sid"], "left").join(langs, "lang", "left").select("lang", "source", "sid", F.coalesce("v", zero).alias("v"), *[(F.coalesce(c, zero) + F.coalesce("v", zero)).alias(m) for c, m in (("size", "m"), ("lang_size", "lang_m"))])
    g = cut(g)
    sizes: dict[str, list[int]] = {}
    for r in g.where("v > 0").select("lang", "sid", "m").orderBy("lang", "sid").collect():
        sizes.setdefault(r["lang"], []).append(r["m"])

    # distinct vectors, the number of terms of each
    vectors = kept.groupBy("lang", "vec").agg(F.count("*").alias("times"))
    more = pair_sums(vectors, {lang: np.array(m, np.int64) for lang, m in sizes.items()})
    z = g.withColumn("p", F.when(F.col("v") > 0, share("0", "greatest(m, 1)")).otherwise(F.lit(1)))
    a, b = z.select("lang", "source", F.col("sid").alias("a"), "v", "p"), z.select("lang", F.col("source").alias("item"), F.col("sid").alias("b"), F.col("p").alias("q"))
    pairs = a.join(b, "lang").where("a <> b").join(more, ["lang", "a", "b"], "left")
    value = (F.col("v").cast("decimal(38,0)") * apart("p", "q") + F.coalesce("more", F.lit(0).cast("decimal(38,0)"))).cast("long")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))

    # the smallest terms of each vector, its values once, and the ranks of the terms
    first = kept.withColumn("r", F.row_number().over(W.partitionBy("lang", "vec").orderBy("term"))).where(F.col("r") <= RANKS)
    lists = first.groupBy("lang", "vec").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    e = lists.select("lang", "terms", F.expr("aggregate(vec, 0L, (s, x) -> s + x.n)").alias("lang_n"), F.explode("vec").alias("x"))
    e = e.select("lang", F.col("x.sid").alias("sid"), F.col("x.n").alias("n"), "lang_n", "terms").join(F.broadcast(g), ["lang", "sid"])
    e = e.select("lang", "source", "terms", share("n", "m").alias("p"), share("lang_n", "lang_m").alias("q")).where("p > q")
    e = e.select("lang", "source", "terms", apart("p", "q").alias("value"), F.get("terms", F.lit(0)).alias("least"))
    e = e.withColumn("r", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "least"))).where(F.col("r") <= RANKS)
    words = e.select("lang", "source", F.lit("term").alias("part"), F.explode("terms").alias("item"), "value")

    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    return pairs.withColumn("rank", rank).unionByName(words.withColumn("rank", rank).where(F.col("rank") <= RANKS))
