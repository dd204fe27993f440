"""MinHash near-dedup: universal hash minima, banding, signature check, exact check, components.

1. One Python pass turns every whole text into its set of five-word shingles, a digest of that set,
   PERMUTATIONS minima of universal hashes, a byte of each as signature, and one key for each band.
2. Rows with equal sets become one representative (their smallest id), so groups of copies cost no pairs.
3. In each bucket (band key) every member is paired with a leader only. Bands choose leaders by four
   seeded orders, so that a chain of near copies hangs together through several leaders. Pairs
   whose signatures agree enough are confirmed on the full sets; components come from those links.
4. Buckets that still hold several components are compared again, across components. Their members are dealt into blocks,
   and each pair of blocks is a task of its own, so that no task reads more than two blocks. First only signatures
   go there; full sets follow for those members that a signature of another component agrees with. Only
   links that join two components leave the task, so no pairs are written out. No bucket is capped.

A pair of similarity s shares a band with probability 1 - (1 - s^ROWS)^BANDS: 1 - 6e-6 at 0.75; its
signatures agree in fewer than AGREE places with a probability of 3e-5 at 0.75 and 2e-8 at 0.8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cut, connected_components, cut, named, portions, unused

BANDS, ROWS = 32, 4
PERMUTATIONS = BANDS * ROWS
WORDS = 5
PERCENT = 75
AGREE = 76
LEADERS = 4
BLOCK, BLOCK_BYTES = 512, 16_000_000
SALTS = 16
_RNG = np.random.Generator(np.random.PCG64(20_240_917))
_A = (_RNG.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64) | 1).astype(np.uint32)[:, None]
_B = _RNG.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)[:, None]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BAND = _RNG.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


class WordHashes(dict):
    """Word → 64-bit hash; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, seen: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; a shorter text is one shingle, an empty one none."""
    own = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not own:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(seen.__getitem__, own), np.uint64, len(own))
    n = max(1, len(w) - words + 1)
    out = np.full(n, np.uint64(min(len(w), words)), np.uint64)
    for i in range(min(words, len(w))):
        out = out * _STEP + w[i : i + n]
    return np.unique(mixed(out))


def minima(s: np.ndarray) -> np.ndarray:
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    x = s.astype(np.uint32)
    for i in range(0, len(x), 4_096):
        low = np.minimum(low, (_A * x[None, i : i + 4_096] + _B).min(axis=1))
    return low


def digest_of(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen = WordHashes()
    for pdf in portions(batches):
        out = []
        for doc_id, text in zip(pdf["doc_id"].array, pdf["text"].array, strict=True):
            s = shingles(text if isinstance(text, str) else None, seen)
            if len(s):
                m = minima(s)
                keys = mixed((m.reshape(BANDS, ROWS).astype(np.uint64) * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _STEP)
                out.append((doc_id, len(s), digest_of(s), keys.astype(np.int64), (m * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes()))
            else:
                out.append((doc_id, 0, None, None, None))
        yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "digest", "bands", "sig"]).astype({"doc_id": "Int64", "n_shingles": "int64"})


def set_digest(texts: pd.Series) -> pd.Series:
    """The digest that ``_sketch`` gives a text."""
    seen = WordHashes()
    return pd.Series([digest_of(shingles(t if isinstance(t, str) else None, seen)) for t in texts], dtype=object)


def _agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        a, b = (np.frombuffer(b"".join(pdf[c]), np.uint8).reshape(-1, PERMUTATIONS) for c in ("sig_a", "sig_b"))
        yield pdf.loc[(a == b).sum(axis=1) >= AGREE, ["a", "b"]]


def similar(s: np.ndarray, t: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of PERCENT / 100 or more."""
    if len(s) > len(t):
        s, t = t, s
    if not len(s) or PERCENT * len(t) > 100 * len(s):
        return False
    at = np.searchsorted(t, s)
    at[at == len(t)] = 0
    both = int((t[at] == s).sum())
    return 100 * both >= PERCENT * (len(s) + len(t) - both)


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, shingles) of rows (node, digest, text) whose text has that digest; a node's equal texts mostly once."""
    seen, done = WordHashes(), set()
    for pdf in portions(batches):
        out = []
        for node, digest, text in zip(pdf["node"].tolist(), pdf["digest"], pdf["text"], strict=True):
            if node not in done and digest_of(s := shingles(text, seen)) == bytes(digest):
                if len(done) > 1_000_000:
                    done.clear()
                done.add(node)
                out.append((node, s.tobytes()))
        yield pd.DataFrame(out, columns=["node", "shingles"]).astype({"node": "int64"})


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        good = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(pdf["set_a"], pdf["set_b"], strict=True)]
        yield pdf.loc[np.array(good, bool), ["a", "b"]]


def _tasks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[int, int, int], pd.DataFrame]]:
    """Whole groups of rows sorted by (key, i, j): at most two blocks each."""
    at, held = None, []
    for pdf in batches:
        for k, part in pdf.groupby(["key", "i", "j"], sort=False):
            if k != at and held:
                yield at, pd.concat(held) if len(held) > 1 else held[0]
                held = []
            at = k
            held.append(part)
    if held:
        yield at, pd.concat(held) if len(held) > 1 else held[0]


def _agreeing(key: tuple[int, int, int], rows: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of block i the later rows (of the same block, or of block j) of other components whose signatures agree."""
    sigs, comps, own = np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(-1, PERMUTATIONS), rows["comp"].to_numpy(), rows["own"].to_numpy()
    left, right = np.flatnonzero(own == key[1]), np.flatnonzero(own == key[2])
    for n, x in enumerate(left.tolist()):
        others = right[n + 1 :] if key[1] == key[2] else right
        others = others[comps[others] != comps[x]]
        if len(others):
            yield x, others[(sigs[others] == sigs[x]).sum(axis=1) >= AGREE]


def _needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Those rows of each task whose signature agrees with one of another component."""
    for key, rows in _tasks(batches):
        some = np.zeros(len(rows), bool)
        for x, others in _agreeing(key, rows):
            if len(others):
                some[x] = some[others] = True
        if some.any():
            yield rows[some]


def _across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of different components, confirmed on the full sets; of each task those that join what it has not joined before."""
    for key, rows in _tasks(batches):
        nodes, comps, up, out = rows["node"].tolist(), rows["comp"].tolist(), {}, []
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]

        def root(c: int) -> int:
            while (to := up.get(c, c)) != c:
                up[c] = c = up.get(to, to)
            return c

        for x, others in _agreeing(key, rows):
            for y in others.tolist():
                r, t = root(comps[x]), root(comps[y])
                if r != t and similar(sets[x], sets[y]):
                    up[r] = t
                    out.append((max(nodes[x], nodes[y]), min(nodes[x], nodes[y])))
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full shingle sets are similar enough; ``sets`` has (node, shingles)."""
    wide = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
    return wide.mapInPandas(_confirm, "a bigint, b bigint").distinct()


def signed(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose signatures agree in AGREE places or more."""
    wide = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
    return wide.mapInPandas(_agree, "a bigint, b bigint").distinct()


def of_keys(members: DataFrame, keys: DataFrame) -> DataFrame:
    """``members`` (key, node, ...) joined with ``keys`` (key, ...), each of which stands there once for each of SALTS parts of its members."""
    salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return members.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(5)), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).drop("salt")


def paired(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """``members`` (key, node, ...) once for each pair of blocks (key, i, j) that its own block is part of."""
    dealt = of_keys(members, blocks).withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "blocks")


def linked_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What both operators below start from.

    rows (doc_id, n_shingles, digest) of ``docs``; sets (digest, rep, node): each set of shingles with the smallest id
    that has it and a number of its own; links (a, b) between those numbers, enough for all components.
    """
    rows = cut(docs.select("doc_id", "text").mapInPandas(_sketch, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>, sig binary"))
    own = rows.where("digest is not null and doc_id is not null")
    reps = cut(own.groupBy("digest").agg(F.min("doc_id").alias("rep")).withColumn("node", F.monotonically_increasing_id()))
    heads = own.join(reps.withColumnRenamed("rep", "doc_id"), ["digest", "doc_id"]).dropDuplicates(["digest", "doc_id"])
    heads = cut(heads.select("node", "n_shingles", "bands", "sig"))
    buckets = heads.select("node", F.posexplode("bands").alias("band", "key"))
    order = F.xxhash64(F.col("node"), F.col("band") % LEADERS)
    # a bucket of one document says nothing
    led = cut(buckets.groupBy("key").agg(F.min_by("node", order).alias("leader"), F.count("*").alias("members")).where("members > 1"))
    met = cut(buckets.select("key", "node").join(led, "key"))
    stars = met.where("node <> leader").select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b")).distinct()
    # full sets of all that share a bucket with another
    some = met.select("node").distinct().join(reps, "node").withColumnRenamed("rep", "doc_id")
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null").join(some, "doc_id")
    sets = cut(texts.select("node", "digest", "text").mapInPandas(_sets, "node bigint, shingles binary"))
    links = cut(confirmed(signed(stars, heads.select("node", "sig")), sets))
    placed = met.where("members > 2").join(connected_components(links).withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    placed = cut(placed.select("key", "node", F.coalesce("component", "node").alias("comp")))
    mixed_up = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    again = cut(of_keys(placed, mixed_up).join(heads.select("node", "sig", "n_shingles"), "node"))
    # a block is small in members and, as far as one member allows it, in bytes
    sized = again.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    tasks = paired(again.drop("n_shingles"), sized).select("key", "i", "j", "own", "node", "comp", "sig")
    tasks = tasks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    needed = Cut(tasks.mapInPandas(_needed, tasks.schema))
    full = needed.df.join(sets, "node").select("key", "i", "j", "own", "node", "comp", "sig", "shingles")
    full = full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    more = cut(full.mapInPandas(_across, "a bigint, b bigint").distinct())
    needed.drop()
    return rows.select("doc_id", "n_shingles", "digest"), reps, links.unionByName(more)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept, digest (of the shingle set).

    Texts are linked if their sets of five-word shingles have a Jaccard similarity of 0.75 or more;
    ``component_id`` is the smallest id reachable over links. Null and empty texts link with nothing.
    Rows that share an id are one document, whatever their texts: all their texts' links are its links. A row
    without an id is linked with nothing but may be named by none: its component is null and it is kept. Texts of any
    length are read whole, in portions bounded in characters. Further columns are not read. An empty table gives an
    empty result.
    """
    rows, reps, links = linked_sets(docs)
    named_rows = rows.where("digest is not null and doc_id is not null")
    twice = named_rows.groupBy("doc_id").agg(F.min(F.xxhash64("digest")).alias("lo"), F.max(F.xxhash64("digest")).alias("hi")).where("lo <> hi").select("doc_id")
    owned = cut(named_rows.join(twice, "doc_id", "left_semi").select("doc_id", "digest").distinct().join(reps.select("digest", "node"), "digest"))
    ties = owned.join(owned.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").where("node <> b").select(F.col("node").alias("a"), "b")
    comps = cut(connected_components(links.unionByName(ties)))
    low = comps.join(reps.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("low"))
    of_set = reps.join(comps.join(low, "component").select("node", "low"), "node", "left").select("digest", F.coalesce("low", "rep").alias("_comp"))
    # a row without words whose id has words elsewhere
    blank = rows.where("digest is null")
    told = named_rows.join(blank.select("doc_id").distinct(), "doc_id", "left_semi").join(of_set, "digest").groupBy("doc_id").agg(F.min("_comp").alias("_comp"))
    cols = ["doc_id", "n_shingles", "digest", "_comp"]
    out = rows.where("digest is not null").join(of_set, "digest", "left").select(*cols).unionByName(blank.join(told, "doc_id", "left").select(*cols))
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("_comp", "doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(True)).alias("kept"), "digest")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs``, with all its columns, without the near duplicates: of each group of linked texts one row stays.

    It is the row of the smallest id (of that id's texts in the group, one). Here every text counts for itself, also
    where rows share an id: an id with two unlike texts keeps both, so no group loses its last text. Of rows with one id and
    one set of shingles one stays, the same in every run. Rows without an id stay. Of rows with one id and texts without
    words one stays. Columns may have any name. An empty table gives an empty result.
    """
    rows, reps, links = linked_sets(docs)
    comps = cut(connected_components(links))
    best = comps.join(reps, "node").groupBy("component").agg(F.min(F.struct("rep", "node")).alias("x")).select("component", F.col("x.node").alias("first"))
    others = comps.join(best, "component").where("node <> first").select("node")
    keepers = reps.join(others, "node", "left_anti").select("digest", F.col("rep").alias("_rep"))
    told = rows.where("doc_id is not null").join(keepers, "digest", "left")
    told = cut(told.select("doc_id", "digest", (F.col("digest").isNull() | (F.coalesce(F.col("_rep") == F.col("doc_id"), F.lit(False)))).alias("stays")))
    ids = cut(told.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or("stays").alias("stays")).where("n > 1 or not stays"))
    every = [named(c) for c in docs.columns]
    out = docs.join(ids.select("doc_id"), "doc_id", "left_anti").select(*every)
    # rows that share an id are told apart by their sets
    row, sign = F.struct(*every), unused(docs.columns, "_digest")
    mark = F.xxhash64(F.to_json(row, {"ignoreNullFields": "false"}))
    several = docs.join(ids.where("n > 1").select("doc_id"), "doc_id", "left_semi").withColumn(sign, F.pandas_udf(set_digest, "binary")(named("text")))
    several = several.groupBy(F.col("doc_id").alias("_id"), F.col(sign).alias("_set")).agg(F.min_by(row, mark).alias("_row"))
    stay = told.where("stays").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_set")).distinct()
    kept = several.alias("l").join(stay.alias("r"), F.expr("l._id = r._id and l._set <=> r._set"), "left_semi")
    return out.unionByName(kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns]))
