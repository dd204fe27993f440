"""Term weights of documents, and what is read from them."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import hold

#: Distinct terms that a task counts, and rows that it makes, before it hands them on.
MOST_COUNTED, MOST_ROWS = 200_000, 50_000
#: Most frequent words whose terms give a bound on how frequent terms must be; most words that tasks are told to be frequent.
PROBED, MOST_FREQUENT = 20_000, 500_000
#: Lengths of the runs of characters that are terms where texts are cut; bits of a character's code and of a row in the number of a run.
LETTERS, CODE_BITS, ROW_BITS = (3, 5), 11, 6
_SPACES = re.compile(r"[ \t\n\x0b\f\r]+")
#: Tokens whose n-grams are numbered at a time; a row of more is taken alone.
MOST_TOKENS = 400_000


def grams(tokens: list[str], low: int, high: int, frequent: set[str] | None = None) -> list[str]:
    """The n-grams of ``low`` to ``high`` words; with ``frequent`` only those all of whose words are among it."""
    out = [t for t in tokens if frequent is None or t in frequent] if low == 1 else []
    if high == 1:
        return out
    run: list[str] = []
    for t in [*tokens, None]:
        if t is not None and (frequent is None or t in frequent):
            run.append(t)
            continue
        for n in range(max(2, low), min(high, len(run)) + 1):
            out += map(" ".join, zip(*[run[k:] for k in range(n)]))
        run = []
    return out


def spread(docs: DataFrame) -> DataFrame:
    """``docs``, computed once; dealt to all cores where it comes from fewer files than there are."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return hold(docs.repartition(cores) if len(docs.inputFiles()) < cores else docs)


def rows_of(column: pa.Array, cut: Callable[[str], list[str]] | None) -> Iterator[list[str]]:
    """The tokens of one row after the other, so that a batch is never whole in Python; ``cut`` makes them from a text."""
    for x in column:
        own = x.as_py()
        yield [] if own is None else cut(own) if cut else own


def portions(lists: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(place of the first row, rows) of portions of lists of tokens, each of at most MOST_TOKENS or of one row."""
    upto = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(lists):
        before = upto[at - 1] if at else 0
        end = max(int(np.searchsorted(upto, before + MOST_TOKENS, side="right")), at + 1)
        yield at, lists.slice(at, end - at)
        at = end


def numbered_grams(lists: pa.Array, low: int, high: int, frequent: pa.Array | None = None) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """``grams`` of all rows of ``lists`` at once: for each number of words (names, row, number), a row and the number of a name for each place."""
    rows = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    words = lists.flatten().dictionary_encode()
    distinct, code = words.dictionary, pc.fill_null(words.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    good = code >= 0
    if frequent is not None and len(distinct):
        good &= pc.is_in(distinct, value_set=frequent.cast(distinct.type)).to_numpy(zero_copy_only=False)[code]
    at = np.flatnonzero(good)
    names, number = distinct, code[at]
    for n in range(1, high + 1):
        if n > 1:
            last = np.minimum(at + n - 1, max(len(code) - 1, 0))
            on = (at + n - 1 < len(code)) & good[last] & (rows[last] == rows[at])
            at, last = at[on], last[on]
            found, number = np.unique(number[on] * len(distinct) + code[last], return_inverse=True)
            names = pc.binary_join_element_wise(names.take(pa.array(found // max(len(distinct), 1))), distinct.take(pa.array(found % max(len(distinct), 1))), pa.scalar(" ", distinct.type))
        if n >= low:
            yield names, rows[at], number


class Runs:
    """Runs of LETTERS characters within words that have a space on either side, as numbers that hold the characters' codes and the row.

    ``terms`` fix the characters that have codes; else each new one has. There is room for 2 ** CODE_BITS - 1 of them.
    """

    def __init__(self, terms: list[str] | None = None) -> None:
        self.grows, self.known, self.code = terms is None, [0], np.zeros(0x110000, np.int64)
        if terms is not None:
            self.meet(np.unique(self.characters("".join(terms))))

    @staticmethod
    def characters(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    def meet(self, characters: np.ndarray) -> None:
        new = characters[self.code[characters] == 0]
        self.code[new] = np.arange(len(self.known), len(self.known) + len(new))
        self.known += new.tolist()

    @property
    def full(self) -> bool:
        return len(self.known) > 1 << CODE_BITS

    def of(self, texts: pa.Array) -> np.ndarray | None:
        """For each run in up to 2 ** ROW_BITS texts its number, shifted by ROW_BITS, and the row; None where there are too many characters."""
        flat = self.characters("\n".join([f" {' '.join(filter(None, _SPACES.split(t or '')))} " for t in texts.to_pylist()]))
        if self.grows:
            self.meet(np.unique(flat))
        if self.full:
            return None
        code, end = self.code[flat], flat == 10
        row, some = np.cumsum(end), (code > 0) & ~end
        letter, out = some & (flat != 32), []
        for k in range(LETTERS[0], LETTERS[1] + 1):
            n = max(len(flat) - k + 1, 0)
            at = np.flatnonzero(np.logical_and.reduce([some[:n], some[k - 1 : k - 1 + n], *[letter[j : j + n] for j in range(1, k - 1)]]))
            out.append(self.packed([code[at + j] for j in range(k)]) << ROW_BITS | row[at])
        return np.concatenate(out)

    @staticmethod
    def packed(codes: list[np.ndarray]) -> np.ndarray:
        return sum(c << CODE_BITS * j for j, c in enumerate(codes))

    def numbers(self, terms: list[str]) -> np.ndarray:
        codes = np.zeros((len(terms), LETTERS[1]), np.int64)
        for i, t in enumerate(terms):
            codes[i, : len(t)] = self.code[[ord(c) for c in t]]
        return self.packed(list(codes.T))

    def names(self, numbers: np.ndarray) -> pa.Array:
        codes = np.stack([numbers >> CODE_BITS * j & (1 << CODE_BITS) - 1 for j in range(LETTERS[1])], axis=1)
        texts = np.array(self.known, np.uint32)[codes].view(f"<U{LETTERS[1]}").ravel().tolist()
        # a text's own last zeros are lost in an array of texts
        return pa.array([t.ljust(n, "\0") for t, n in zip(texts, (codes > 0).sum(axis=1).tolist(), strict=True)], pa.string())


class RunCounts:
    """Numbers of rows and of places of runs, added up over portions."""

    def __init__(self) -> None:
        self.runs, self.parts = Runs(), []

    def add(self, found: np.ndarray) -> None:
        own, times = np.unique(found, return_counts=True)
        number = own >> ROW_BITS
        first = np.flatnonzero(np.diff(number, prepend=-1))
        if len(first):
            self.parts.append((number[first], np.diff(first, append=len(number)), np.add.reduceat(times, first)))
        if sum(len(p[0]) for p in self.parts[1:]) > MOST_COUNTED:
            self.parts = [self.total()]

    def total(self) -> tuple[np.ndarray, ...]:
        number, df, cf = (np.concatenate([np.zeros(0, np.int64), *[p[i] for p in self.parts]]) for i in range(3))
        distinct, at = np.unique(number, return_inverse=True)
        return distinct, *[np.bincount(at, x, minlength=len(distinct)).astype(np.int64) for x in (df, cf)]

    def batch(self) -> pa.RecordBatch:
        number, df, cf = self.total()
        return pa.RecordBatch.from_arrays([self.runs.names(number), pa.array(df), pa.array(cf)], ["term", "df", "cf"])


def cut_portions(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """``portions`` of texts, each of at most 2 ** ROW_BITS rows, and of MOST_TOKENS characters or of one row."""
    upto = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        before = upto[at - 1] if at else 0
        end = min(max(int(np.searchsorted(upto, before + MOST_TOKENS, side="right")), at + 1), at + (1 << ROW_BITS))
        yield at, texts.slice(at, end - at)
        at = end


def term_counts(docs: DataFrame, tokens: str, low: int, high: int, frequent: set[str] | None, cut: Callable[[str], list[str]] | None = None) -> DataFrame:
    """(term, df, cf): numbers of documents that have each n-gram, and of its places. Tasks add up MOST_COUNTED terms, or those of MOST_TOKENS tokens, first, whatever the size of a batch. With ``cut`` the terms are the runs of a text, which ``Runs`` counts; it cuts texts of more characters than there are codes."""
    told = None if frequent is None or cut else pa.array(sorted(frequent), pa.string())

    def by_number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, lists in portions(batch.column(0)):
                for names, row, number in numbered_grams(lists, low, high, told):
                    k = len(names)
                    cf = np.bincount(number, minlength=k)
                    df = np.bincount(np.unique(row * k + number) % max(k, 1), minlength=k)
                    some = np.flatnonzero(cf)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(some)).cast(pa.string()), pa.array(df[some], pa.int64()), pa.array(cf[some], pa.int64())], ["term", "df", "cf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = RunCounts()
        for batch in batches:
            for _, texts in cut_portions(batch.column(0)):
                found = counts.runs.of(texts)
                if found is None or counts.parts and len(counts.parts[0][0]) > MOST_COUNTED:
                    yield counts.batch()
                    counts = RunCounts()
                    found = counts.runs.of(texts)
                if found is not None:
                    counts.add(found)
                    continue
                for t in rows_of(texts, cut):  # more characters than there are codes
                    own = Counter(t)
                    yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array([1] * len(own), pa.int64()), pa.array(list(own.values()), pa.int64())], ["term", "df", "cf"])
                counts = RunCounts()
        yield counts.batch()

    return docs.select(F.col(tokens).alias("t")).mapInArrow(run if cut else by_number, "term string, df bigint, cf bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def vocabulary(docs: DataFrame, tokens: str, low: int, high: int, most: int, min_df: int, max_df: float, cut: Callable[[str], list[str]] | None = None) -> dict[str, float]:
    """Term → idf of the ``most`` most frequent n-grams in at least ``min_df`` and at most ``max_df`` of all documents, ties by term.

    An n-gram is no more frequent than each of its words. If single words are terms, longer ones are therefore
    counted only where all their words are as frequent as the last single word that would be chosen; if not, as the last of
    the shortest terms that would be chosen among those of the PROBED most frequent words, which is no more frequent than the last of all.
    """
    n = docs.count()
    words = term_counts(docs, tokens, 1, 1, None, cut).where(F.col("df") >= min_df)
    within = F.col("df") <= max_df * n
    frequent: set[str] | None = None
    if high > 1:
        words = hold(words)
        first = words
        if low > 1:
            probed = {r["term"] for r in words.orderBy(F.desc("cf"), "term").limit(PROBED).collect()}
            first = term_counts(docs, tokens, low, low, probed, cut).where(F.col("df") >= min_df)
        least = first.where(within).orderBy(F.desc("cf"), "term").limit(most).agg(F.count("*").alias("k"), F.min("cf").alias("cf")).first()
        floor = least["cf"] if least["k"] == most else 0
        kept = words.where(F.col("cf") >= floor).select("term").limit(MOST_FREQUENT + 1) if floor > 0 else None
        frequent = {r["term"] for r in kept.collect()} if kept is not None else None
        frequent = None if frequent is not None and len(frequent) > MOST_FREQUENT else frequent
    counts = term_counts(docs, tokens, low, high, frequent, cut) if high > 1 or low > 1 else words
    chosen = counts.where((F.col("df") >= min_df) & within).orderBy(F.desc("cf"), "term").limit(most)
    return {r["term"]: math.log((1 + n) / (1 + r["df"])) + 1 for r in chosen.collect()}


def tfidf(docs: DataFrame, tokens: str, *, low: int = 1, high: int = 3, most_features: int = 4000, min_df: int = 2, max_df: float = 0.97, sublinear: bool = True, top: int | None = None, digits: int = 6, cut: Callable[[str], list[str]] | None = None) -> DataFrame:
    """(record_id, term, weight): unit-length TF-IDF rows with smoothed idf, ln((1 + n) / (1 + df)) + 1.

    Terms are n-grams in at least ``min_df`` and at most ``max_df`` of all documents; of these the ``most_features``
    most frequent stay, ties by term. With ``top`` only the heaviest terms of a document are returned. A document is a
    row and is counted in that row, so that nothing is shuffled by document. With ``cut``, ``tokens`` names a text, and its
    tokens are made where they are counted and never held.
    """
    docs = spread(docs.select("record_id", F.col(tokens).alias("t")))
    idf = vocabulary(docs, "t", low, high, most_features, min_df, max_df, cut)
    frequent = {w for t in idf for w in t.split(" ")} if high > 1 else set(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, terms, weights = [], [], []
            flush = lambda b, i, t, w: pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i, pa.int64())), pa.array(t, pa.string()), pa.array(w, pa.float64())], ["record_id", "term", "weight"])
            for i, t in enumerate(rows_of(batch.column(1), cut)):
                tf = Counter(x for x in grams(t, low, high, frequent) if x in idf)
                w = {x: (1 + math.log(c) if sublinear else c) * idf[x] for x, c in tf.items()}
                norm = math.sqrt(sum(v * v for v in w.values()))
                best = sorted(((x, v / norm) for x, v in w.items()), key=lambda x: (-math.floor(x[1] * 1e9 + 0.5), x[0]))[:top]
                ids += [i] * len(best)
                terms += [x for x, _ in best]
                weights += [v for _, v in best]
                if len(ids) > MOST_ROWS:
                    yield flush(batch, ids, terms, weights)
                    ids, terms, weights = [], [], []
            yield flush(batch, ids, terms, weights)

    kind = docs.schema["record_id"].dataType.simpleString()
    out = docs.select("record_id", "t").mapInArrow(run, f"record_id {kind}, term string, weight double")
    return out.select("record_id", "term", F.round("weight", digits).alias("weight"))


def term_rows(docs: DataFrame, tokens: str, *, low: int = 1, high: int = 3, most_features: int = 4000, min_df: int = 2, max_df: float = 0.97, digits: int = 12, cut: Callable[[str], list[str]] | None = None) -> tuple[list[str], DataFrame]:
    """The terms in order, and the rows (record_id, at, weight) of sublinear ``tfidf`` by the numbers of terms, of held ``docs``; rows without a term are left out."""
    idf = vocabulary(docs, tokens, low, high, most_features, min_df, max_df, cut)
    terms = sorted(idf)
    place = {t: i for i, t in enumerate(terms)}
    weights = np.array([idf[t] for t in terms])
    frequent = {w for t in idf for w in t.split(" ")} if high > 1 else set(idf)
    listed, told = pa.array(terms, pa.string()), pa.array(sorted(frequent), pa.string())

    def entries(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row and term of each place that has a term."""
        if cut:
            own = [[place[x] for x in t if x in place] for t in rows_of(lists, cut)]
            return np.repeat(np.arange(len(own)), [len(f) for f in own]), np.array([x for f in own for x in f], dtype=np.int64)
        rows, ats = [], []
        for names, row, number in numbered_grams(lists, low, high, told):
            term = pc.fill_null(pc.index_in(names, value_set=listed.cast(names.type)), -1).to_numpy(zero_copy_only=False)[number].astype(np.int64)
            rows.append(row[term >= 0])
            ats.append(term[term >= 0])
        return np.concatenate(rows), np.concatenate(ats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(terms) if cut else None
        numbers = runs.numbers(terms) if cut and not runs.full else np.zeros(0, np.int64)
        order = np.argsort(numbers)
        for batch in batches:
            column = batch.column(1)
            for first, lists in cut_portions(column) if cut else portions(column):
                if cut and len(numbers):
                    found = runs.of(lists)
                    place_of = np.minimum(np.searchsorted(numbers, found >> ROW_BITS, sorter=order), len(numbers) - 1)
                    term = order[place_of]
                    good = numbers[term] == found >> ROW_BITS
                    every = np.bincount((found[good] & (1 << ROW_BITS) - 1) * len(terms) + term[good], minlength=1)
                    both = np.flatnonzero(every)
                    count = every[both]
                else:
                    row, at = entries(lists)
                    both, count = np.unique(row * len(terms) + at, return_counts=True)
                row, at = both // max(len(terms), 1), both % max(len(terms), 1)
                w = (1 + np.log(count)) * weights[at]
                w = np.round(w / np.sqrt(np.bincount(row, w * w, minlength=len(lists)))[row], digits)
                own, size = np.unique(row, return_counts=True)
                ends = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + own, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(at, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(w, pa.float64()))], ["record_id", "at", "weight"])

    kind = docs.schema["record_id"].dataType.simpleString()
    return terms, docs.select("record_id", tokens).mapInArrow(run, f"record_id {kind}, at array<int>, weight array<double>")


def preprocessing_audit(docs: DataFrame, text: Column, normal: Column, tokens: Column) -> DataFrame:
    return docs.select("record_id", text.rlike("[一-鿿]").alias("contains_cjk"), F.char_length(text).cast("long").alias("raw_characters"), F.char_length(normal).cast("long").alias("normalized_characters"), F.size(tokens).cast("long").alias("tokens"), F.array_join(F.slice(tokens, 1, 30), " ").alias("first_tokens"))


def npmi_coherence(docs: DataFrame, tokens: str, topics: DataFrame) -> DataFrame:
    """Mean normalised pointwise mutual information of the pairs of each topic's terms (topic_id, term)."""
    n = docs.agg(F.count("*").alias("n"))
    has = docs.select("record_id", F.explode(F.array_distinct(tokens)).alias("term")).join(F.broadcast(topics), "term")
    single = has.groupBy("topic_id", "term").agg(F.count("*").alias("d"))
    other = has.select("record_id", "topic_id", F.col("term").alias("u"))
    pair = has.join(other, ["record_id", "topic_id"]).where("term < u").groupBy("topic_id", "term", "u").agg(F.count("*").alias("both"))
    every = topics.join(topics.select("topic_id", F.col("term").alias("u")), "topic_id").where("term < u")
    p = every.join(pair, ["topic_id", "term", "u"], "left").join(single.select("topic_id", "term", F.col("d").alias("da")), ["topic_id", "term"]).join(single.select("topic_id", F.col("term").alias("u"), F.col("d").alias("db")), ["topic_id", "u"]).crossJoin(F.broadcast(n))
    joint = F.col("both") / F.col("n")
    value = F.when(F.col("both").isNull(), -1.0).when(F.col("both") == F.col("n"), 1.0).otherwise(F.log(joint * F.col("n") * F.col("n") / (F.col("da") * F.col("db"))) / -F.log(joint))
    return p.groupBy("topic_id").agg(F.round(F.avg(value), 6).alias("coherence"))


def contains_any(text: Column, terms: list[str]) -> Column:
    """Those of ``terms`` that a text contains, whatever the case."""
    return F.array_compact(F.array(*[F.when(F.contains(F.lower(text), F.lit(t.lower())), F.lit(t)) for t in terms])) if terms else F.array().cast("array<string>")


def focus_hits(records: DataFrame, fields: list[str], terms: list[str]) -> DataFrame:
    """(record_id, field, term): terms in fields, whatever the case."""
    rows = F.flatten(F.array(*[_hits(f, terms) for f in fields]))
    return records.select("record_id", F.explode(rows).alias("x")).select("record_id", "x.field", "x.term")


def _hits(field: str, terms: list[str]) -> Column:
    found = contains_any(F.coalesce(F.col(field), F.lit("")), terms)
    return F.transform(found, lambda t: F.struct(F.lit(field).alias("field"), t.alias("term")))


def classify_focus(records: DataFrame, plan: dict) -> DataFrame:
    """(record_id, classification, confidence, groups): where a record stands to a plan of required and other concept groups.

    Where records have ``query_ids``, a theory query counts like a mechanism term, and a direct query with any group leaves a
    record for review whatever the plan does with the others.
    """
    text = F.concat_ws("\n", *[F.coalesce(F.col(f), F.lit("")) for f in plan["match_fields"]])
    hit = lambda terms: F.size(contains_any(text, terms)) > 0
    groups = plan["core_groups"]
    found = F.array_compact(F.array(*[F.when(hit(g["terms"]), F.lit(g["id"])) for g in groups]))
    required = [g["id"] for g in groups if g.get("required")]
    r = records.withColumn("_g", found).withColumn("_out", hit(plan.get("exclusion_terms", []))).withColumn("_adj", hit(plan.get("adjacent_terms", []))).withColumn("_mech", hit(plan.get("mechanism_terms", [])))
    every = F.size(F.array_except(F.array(*map(F.lit, required)), "_g")) == 0 if required else F.lit(True)
    enough = F.size("_g") >= plan.get("minimum_core_groups", 1)
    empty = F.length(F.regexp_replace(text, r"\s", "")) == 0
    found_by = lambda ids: F.coalesce(F.arrays_overlap("query_ids", F.array(*[F.lit(str(i)) for i in ids])), F.lit(False)) if ids and "query_ids" in records.columns else F.lit(False)
    r = r.withColumn("_theory", found_by(plan.get("theory_query_ids"))).withColumn("_direct", found_by(plan.get("direct_query_ids")))
    c = (
        F.when(F.col("_out"), "excluded").when(every & enough, "core").when(F.col("_adj") & (F.col("_mech") | F.col("_theory")), "theory-supplement")
        .when(F.col("_direct") & (F.size("_g") > 0), "needs-review").when(empty, "needs-review").otherwise(plan.get("unmatched_action", "needs-review"))
    )
    conf = F.when(F.col("_c").isin("core", "excluded") & (F.col("_out") | every), "high").when(F.col("_c") == "theory-supplement", "medium").otherwise("low")
    return r.withColumn("_c", c).select("record_id", F.col("_c").alias("classification"), conf.alias("confidence"), F.array_join(F.array_sort("_g"), ",").alias("groups"))
