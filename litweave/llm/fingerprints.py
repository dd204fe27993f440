"""Document fingerprints by I-Match with randomised lexicon subsets.

Only DataFrame functions: no Python code touches a row.

The lexicon holds the terms whose inverse document frequency lies in a band, that is whose document
frequency is between ``LOW_DF`` and ``HIGH_DF`` of all documents. All documents are counted. The lexicon
has at most (mean number of distinct terms of a document) / LOW_DF entries, however large the corpus is,
so it can be handed to every task as one array of hash slots.

A document's terms that are in the lexicon are sorted, and the sorted list is hashed once for the whole
lexicon and once for each of ``len(SUBSETS)`` random subsets. Subsets come in several densities, so
that short and long documents alike have some subsets in which they hold only a term or two; as short texts have
few terms of the lexicon, the last ALL_PARTS are parts of all their terms (and empty for texts of more than SHORT_TERMS). The likeness
of two fingerprints is the share of equal hashes among the subsets that are not empty in both.
A document without lexicon terms is hashed over all its terms; the empty text over none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LOW_DF, HIGH_DF = 0.002, 0.2
SLOTS = 1 << 15
#: Bits that thin the lexicon before it is parted in 16 (in 4 at the first): five densities.
DENSITIES = ((0, 4), (0, 16), (2, 16), (4, 16), (6, 16))
#: Parts of all terms, in the lexicon or not, of texts of few distinct terms: these have few of the lexicon.
ALL_PARTS, SHORT_TERMS = 32, 64
SUBSETS = [(thin, part) for thin, parts in DENSITIES for part in range(parts)] + [(None, part) for part in range(ALL_PARTS)]
DOCS_PER_RANGE, MOST_RANGES = 4_000, 65_536
#: White space, punctuation and controls of ASCII part terms.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-case terms of a text."""
    return F.transform(F.filter(F.array_distinct(F.split(F.lower(text), BETWEEN)), lambda w: w != ""), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, low: float = LOW_DF, high: float = HIGH_DF) -> DataFrame:
    """(h): hashes of the terms within the band."""
    n = docs.count()
    counted = docs.select(F.explode(F.array_distinct(F.split(F.lower("text"), BETWEEN))).alias("w")).where("w <> ''")
    df = counted.select(F.xxhash64("w").alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    return df.where((F.col("df") >= max(1.0, low * n)) & (F.col("df") <= max(1.0, high * n))).select("h")


def slots(lex: DataFrame) -> DataFrame:
    """One row: the lexicon as SLOTS arrays of hashes, each hash in the slot of its lowest bits."""
    spark = lex.sparkSession
    own = lex.groupBy((F.col("h").bitwiseAND(F.lit(SLOTS - 1))).alias("slot")).agg(F.array_sort(F.collect_list("h")).alias("hs"))
    every = spark.range(SLOTS).withColumnRenamed("id", "slot").join(own, "slot", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", F.coalesce("hs", F.array().cast("array<bigint>")).alias("hs")))), lambda x: x["hs"]).alias("lex"))


def parted(base: Column, shift: int, parts: int) -> Column:
    """One hash for each of ``parts`` parts of a sorted array of term hashes, by bits from ``shift`` on; 0 for an empty one."""
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))
    own = lambda p: F.filter(base, lambda h: F.shiftright(h, shift).bitwiseAND(F.lit(parts - 1)) == p)
    hashed = lambda s: F.when(F.size(s) == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(s))
    return F.transform(numbers, lambda p: let(own(p), hashed))


def subset_hashes(kept: Column, every: Column) -> Column:
    """One hash for each subset of the sorted hashes of a text's lexicon terms, and for each part of those of all its terms if these are few."""

    def thinned(shift: int, thin: int, parts: int) -> Column:
        base = kept if not thin else F.filter(kept, lambda h: F.shiftright(h, shift).bitwiseAND(F.lit((1 << thin) - 1)) == 0)
        return let(base, lambda b: parted(b, shift + thin, parts))

    groups, shift = [], 15
    for thin, parts in DENSITIES:
        groups.append(thinned(shift, thin, parts))
        shift += thin + 4
    none = F.array_repeat(F.lit(0).cast("long"), ALL_PARTS)
    return F.flatten(F.array(*groups, F.when(F.size(every) <= SHORT_TERMS, let(F.array_sort(every), lambda e: parted(e, shift, ALL_PARTS))).otherwise(none)))


def signatures(texts: Column, lex: Column) -> Column:
    """For each of an array of texts (none null) its 1 + len(SUBSETS) hashes.

    ``lex`` is a column holding the scalar subquery with the slots. It is named once, so that the
    optimizer puts the subquery's value here and no row carries it.
    """

    def of(all_terms: Column, table: Column) -> Column:
        kept = F.array_sort(F.filter(all_terms, lambda h: F.array_contains(F.get(table, h.bitwiseAND(F.lit(SLOTS - 1)).cast("int")), h)))
        whole = lambda k: F.when(F.size(k) > 0, F.xxhash64(k)).otherwise(F.xxhash64(F.lit("no lexicon term"), F.array_sort(all_terms)))
        return let(kept, lambda k: F.concat(F.array(whole(k)), subset_hashes(k, all_terms)))

    return let(lex, lambda table: F.transform(texts, lambda text: let(terms(text), lambda t: of(t, table))))


def as_text(sig: Column) -> Column:
    """16 hex digits for the whole lexicon, then 4 for each subset, "-" for an empty one."""
    short = F.transform(F.slice(sig, 2, len(SUBSETS)), lambda h: F.when(h == 0, "-").otherwise(F.lpad(F.hex(h.bitwiseAND(F.lit(0xFFFF))), 4, "0")))
    return F.concat_ws(":", F.lpad(F.hex(F.get(sig, F.lit(0))), 16, "0"), F.array_join(short, ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among those subsets that are not empty in both signatures."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x != 0)), lambda t: t))
    some = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != 0) | (y != 0)), lambda t: t))
    return same.cast("double") / some


def with_next(docs: DataFrame) -> tuple[DataFrame, W]:
    """Rows (doc_id, text, range, guest) and the window in which the row after each is the next document.

    Ids are cut into ranges of about equal counts, and each range is a window partition of its own.
    The first document of the following range (after the last range: of the first) joins a range as a
    guest at its end, so that every row finds its next one without a sort of all rows in one task.
    """
    counts = docs.select(F.count("*").alias("n")).first()["n"]
    ranges = max(1, min(MOST_RANGES, -(-counts // DOCS_PER_RANGE)))
    cuts = docs.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges + 10_000)).first()[0] if ranges > 1 else None
    cuts = sorted(set(cuts or []))
    if cuts:
        table = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
        steps, p = [], 1
        while p <= len(cuts):
            steps.insert(0, p)
            p *= 2
        found = let(table, lambda t: F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda lo, s: F.when((lo + s <= len(cuts)) & F.coalesce(F.get(t, lo + s - 1) < F.col("doc_id"), F.lit(True)), lo + s).otherwise(lo)))
    else:
        found = F.lit(0)
    d = docs.select("doc_id", "text", found.alias("range"), F.lit(False).alias("guest"))
    firsts = [tuple(r) for r in d.groupBy("range").agg(F.min("doc_id").alias("first")).orderBy("range").collect()]
    if firsts:
        after = {first: at for (at, _), (_, first) in zip(firsts, firsts[1:] + firsts[:1], strict=True)}
        spark = docs.sparkSession
        to = spark.createDataFrame([(k, v) for k, v in after.items()], "first bigint, range int")
        head = d.join(F.broadcast(to.select("first")), F.col("doc_id").eqNullSafe(F.col("first")), "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
        guests = head.join(F.broadcast(to), F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "text", "range", F.lit(True).alias("guest"))
        d = d.unionByName(guests)
    return d, W.partitionBy("range").orderBy("guest", F.col("doc_id").asc_nulls_last(), "text")


def fingerprints(docs: DataFrame, low: float = LOW_DF, high: float = HIGH_DF) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_chars, signature.

    A null text counts as empty. Equal texts have equal signatures. An empty table gives an empty result.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lex = slots(lexicon(d, low, high)).scalar()
    d = d.withColumn("_lex", lex)
    return d.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.get(signatures(F.array("text"), F.col("_lex")), F.lit(0)).alias("signature"))


def fingerprints_with_edit(docs: DataFrame, low: float = LOW_DF, high: float = HIGH_DF) -> DataFrame:
    """Signatures of every text, of its edited text and of the next document's text, and their likeness.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many
    (or all) of the next document by ascending id; after the last document comes the first. Rows that share
    an id stand in the order of their texts; null ids come last; null texts count as empty.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lex = slots(lexicon(d, low, high)).scalar()
    rows, w = with_next(d)
    n = F.char_length("text")
    half = "cast(floor(char_length(text) / 2) as int)"
    edited = F.concat(F.expr(f"substring(text, 1, char_length(text) - {half})"), F.expr(f"substring(coalesce(_next, ''), 1, {half})"))
    r = rows.withColumn("_next", F.lead("text").over(w)).withColumn("_lex", lex)
    # "edited" and "_lex" are each named once, so that the two projections become one
    both = let(F.array(F.col("text"), edited), lambda t: F.struct(F.sha2(t[1], 256).alias("sha"), signatures(t, F.col("_lex")).alias("sigs")))
    r = r.select("doc_id", "range", "guest", "text", n.cast("long").alias("n_chars"), both.alias("_both"))
    r = r.select("doc_id", "range", "guest", "text", "n_chars", F.col("_both.sha").alias("edited_sha256"), F.col("_both.sigs").alias("_sigs"))
    r = r.select("doc_id", "range", "guest", "text", "n_chars", "edited_sha256", F.col("_sigs")[0].alias("sig"), F.col("_sigs")[1].alias("edited_sig"))
    r = r.withColumn("next_sig", F.lead("sig").over(w)).where("not guest")
    return r.select("doc_id", "n_chars", "edited_sha256", "sig", "edited_sig", likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"))
