"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Only DataFrame functions: no Python code touches a row.

1. Every document's size is its number of words; sizes are summed by (source, shard).
2. Targets are water-filled: ``min(2 * source_size, level * weight)`` with the level at which they
   add up to the budget, found from running sums over the sources in order of cap / weight.
3. The budget is cut into blocks of equal tokens. Sources get blocks by highest quotients
   ``target / (2 i + 1)``, then runs of SHARDS_AT_ONCE shards of a source get that source's blocks, and the shards of
   a run that run's blocks, the same way, so that no task ranks all shards of a source.
   A seat's number differs from its exact share by a bounded amount (see ``apportion``), so only the
   quotients near that share are made and ranked; the seats below them are certain.
4. A shard's documents stand in a seeded order on a line of words. Its blocks are taken from a seeded
   starting block onward, around the ring and at most twice, so nothing but running sums is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, WORD, cut

BLOCK_WORDS = 64
SHARD_DOCS = 2_000
SHARDS_AT_ONCE = 1_000
SEED = "mix-1"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2


def hashed(*parts: Column) -> Column:
    """A seeded non-negative number below 2**52, the same on every engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts])), 1, 13), 16, 10).cast("long")


def apportion(df: DataFrame, group: list[str], weight: str, seats: str, order: list[str]) -> DataFrame:
    """Sainte-Laguë: adds ``quota``, the integer share of ``seats`` (constant in a group) that a row gets for its ``weight``.

    With n rows, B seats and exact shares q, the divisor that gives B seats differs from the mean
    divisor by a factor of at most 1 + n / (2 B), because rounding n shares moves their sum by n / 2
    at most. A row's seats are therefore within 1 + q n / (2 B) of q: that many quotients on either
    side are ranked, about 5 n in all, and all lower seats are given outright. Ties go by ``order``.
    """
    w = W.partitionBy(*group)
    share = F.when(F.col("_all") > 0, F.col(weight) * F.col(seats) / F.col("_all")).otherwise(0.0)
    lo = (
        df.withColumn("_all", F.sum(F.col(weight).cast("double")).over(w))
        .withColumn("_n", F.count("*").over(w))
        .withColumn("_q", share)
        .withColumn("_c", (F.lit(2) + F.ceil(F.when(F.col(seats) > 0, F.col("_q") * F.col("_n") / (2 * F.col(seats))).otherwise(0.0))).cast("long"))
        .withColumn("_sure", F.greatest(F.lit(0), F.floor("_q").cast("long") - F.col("_c")))
        .withColumn("_rest", F.col(seats) - F.sum("_sure").over(w))
    )
    ranked = (
        lo.withColumn("_i", F.explode(F.sequence(F.col("_sure"), (F.ceil("_q") + F.col("_c")).cast("long"))))
        .withColumn("_quotient", F.col(weight) / (2 * F.col("_i") + 1))
        .withColumn("_rank", F.row_number().over(w.orderBy(F.desc("_quotient"), *order, "_i")))
        .where((F.col("_rank") <= F.col("_rest")) & (F.col(weight) > 0))
    )
    extra = ranked.groupBy(*group, *order).agg(F.count("*").alias("_extra"))
    on = [df[c].eqNullSafe(extra[c]) for c in dict.fromkeys(group + order)]
    keys = list(dict.fromkeys(group + order))
    named = extra.select(*[F.col(c).alias(f"_k_{c}") for c in keys], "_extra")
    joined = lo.join(named, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys], "left")
    return joined.withColumn("quota", F.col("_sure") + F.coalesce("_extra", F.lit(0))).select(*df.columns, "quota")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size) → with weight and target. One row per source, so its windows hold a short list."""
    by_name = W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    ratio = W.partitionBy(F.lit(0)).orderBy("_ratio", F.col("source").asc_nulls_last())
    done = ratio.rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy(F.lit(0))
    k = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (k % len(weights) + 1).cast("int"))
    s = (
        sources.withColumn("weight", weight)
        .withColumn("_cap", F.lit(float(repeats)) * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_budget", share * F.sum("source_size").over(every))
        # the level if this source and all with a lower ratio are not capped but those before it are
        .withColumn("_caps_before", F.sum("_cap").over(done) - F.col("_cap"))
        .withColumn("_weights_left", F.sum("weight").over(every) - F.sum("weight").over(done) + F.col("weight"))
        .withColumn("_level", (F.col("_budget") - F.col("_caps_before")) / F.col("_weights_left"))
        .withColumn("_found", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct(F.row_number().over(ratio).alias("r"), F.col("_level").alias("level")))).over(every))
    )
    return s.withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("_found.level"), F.lit(float("inf"))) * F.col("weight"))).select("source", "source_size", "weight", "target")


def mix(docs: DataFrame, *, block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, shards_at_once: int = SHARDS_AT_ONCE, seed: str = SEED, weights=WEIGHTS, share: float = SHARE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, first_word, with the columns named in ``keep``.

    ``taken`` words of a document are in the mix, repeats counted: ``taken div size`` whole copies and
    ``taken mod size`` words more from word ``first_word`` on, wrapping at the document's end.
    A null text has size 0 and nothing taken; a null source is a source of its own, named last.
    Rows with equal ids and sizes are interchangeable. An empty table gives an empty result.
    """
    d = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *keep)
    d = d.withColumn("_h", hashed(F.lit(seed), F.col("doc_id")))
    if not keep:
        d = cut(d)
    n = d.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    n = n.withColumn("shards", F.ceil(F.col("docs") / shard_docs).cast("long"))
    src = targets(n.select("source", "source_size"), weights, share)
    src = src.withColumn("_blocks", F.round(F.sum("target").over(W.partitionBy(F.lit(0))) / block_words).cast("long")).withColumn("_one", F.lit(0))
    src = apportion(src, ["_one"], "target", "_blocks", ["source"]).withColumnRenamed("quota", "source_blocks")
    src = src.join(n.select(F.col("source").alias("_s"), "shards"), F.col("source").eqNullSafe(F.col("_s"))).select("source", "source_size", "target", "source_blocks", "shards")
    src = cut(src)
    few = src.select(F.col("source").alias("_s"), "source_size", "target", "source_blocks", "shards")
    d = d.join(few, F.col("source").eqNullSafe(F.col("_s"))).withColumn("shard", F.col("_h") % F.col("shards"))
    shard = d.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_blocks").alias("source_blocks"))
    shard = shard.withColumn("run", F.floor(F.col("shard") / shards_at_once))
    run = shard.groupBy("source", "run").agg(F.sum("shard_size").alias("run_size"), F.first("source_blocks").alias("source_blocks"))
    run = cut(apportion(run, ["source"], "run_size", "source_blocks", ["source", "run"])).select(F.col("source").alias("_s3"), F.col("run").alias("_n3"), F.col("quota").alias("run_blocks"))
    shard = shard.join(run, F.col("source").eqNullSafe(F.col("_s3")) & (F.col("run") == F.col("_n3"))).select("source", "run", "shard", "shard_size", "run_blocks")
    shard = cut(apportion(shard, ["source", "run"], "shard_size", "run_blocks", ["source", "run", "shard"]))
    shard = shard.select(
        F.col("source").alias("_s2"), F.col("shard").alias("_n2"), "shard_size",
        F.ceil(F.col("shard_size") / block_words).cast("long").alias("_have"), "quota",
    ).withColumn("quota", F.least("quota", MOST_REPEATS * F.col("_have"))).withColumn("_start", hashed(F.lit(seed), F.lit("start"), F.col("_s2"), F.col("_n2")) % F.greatest("_have", F.lit(1)))
    d = d.join(shard, F.col("source").eqNullSafe(F.col("_s2")) & (F.col("shard") == F.col("_n2")))
    line = W.partitionBy("source", "shard").orderBy("_h", "doc_id", "size")
    d = d.withColumn("_to", F.sum("size").over(line.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("_from", F.col("_to") - F.col("size"))
    turns = F.when(F.col("_have") > 0, F.floor(F.col("quota") / F.col("_have"))).otherwise(0).cast("long")
    rest = F.when(F.col("_have") > 0, F.col("quota") % F.col("_have")).otherwise(0).cast("long")
    a = F.col("_start") * block_words
    # blocks [start, start + rest) around the ring: the part up to the line's end, and the part from its start
    b = F.least((F.col("_start") + rest) * block_words, F.col("shard_size"))
    over = F.greatest(F.lit(0), F.col("_start") + rest - F.col("_have")) * block_words
    first = F.greatest(F.lit(0), F.least("_to", b) - F.greatest("_from", a))
    second = F.greatest(F.lit(0), F.least("_to", over) - F.col("_from"))
    taken = turns * F.col("size") + first + second
    return d.select(
        "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"),
        F.when((first > 0), F.greatest("_from", a) - F.col("_from")).otherwise(0).cast("long").alias("first_word"), *keep,
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: every document as often as the mix takes it.

    Documents taken whole keep their text; of one taken in part, which happens only where the blocks taken
    from a shard begin or end, a further row has the words taken, with single spaces between them. Documents of which
    nothing is taken, among them those without words, are not in the mix.
    """
    whole = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    m = mix(whole, keep=("_row",)).where("taken > 0")
    m = m.withColumn("_rest", (F.col("taken") % F.col("size")).cast("int")).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    part = (F.col("_rest") > 0) & (F.col("_copy") > F.floor(F.col("taken") / F.col("size")))
    words = F.filter(F.split("_row.text", rf"[{SPACES}]+"), lambda w: w != "")
    some = F.array_join(F.slice(F.concat(words, words), F.col("first_word").cast("int") + 1, F.col("_rest")), " ")
    m = m.withColumn("_part", part).withColumn("_text", F.when(F.col("_part"), some).otherwise(F.col("_row.text")))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_part"), F.char_length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return m.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
