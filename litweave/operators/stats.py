"""Counts, ranks and selections over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def known_year() -> Column:
    return F.col("year").isNotNull() & (F.col("year") != 0)


def year_stats(records: DataFrame) -> DataFrame:
    """Documents and citations of each year."""
    return records.where(known_year()).groupBy("year").agg(F.count("*").alias("documents"), F.sum("citations").alias("citations"))


def term_stats(records: DataFrame, terms: str = "keywords") -> DataFrame:
    """Per term: documents, citations, documents of the last three years, and how much denser it is in those than before."""
    r = records.select("record_id", "citations", F.coalesce("year", F.lit(0)).alias("year"), F.array_distinct(terms).alias("t"))
    last = records.agg(F.coalesce(F.max("year"), F.lit(0)).alias("last"))
    total = r.crossJoin(F.broadcast(last)).agg(F.count_if(F.col("year") >= F.col("last") - 2).alias("recent"), F.count_if(F.col("year") < F.col("last") - 2).alias("prior"), F.max("last").alias("last"))
    t = r.select("citations", "year", F.explode("t").alias("term")).crossJoin(F.broadcast(total))
    recent = F.count_if(F.col("year") >= F.col("last") - 2)
    burst = recent / F.greatest(F.max("recent"), F.lit(1)) - (F.count("*") - recent) / F.greatest(F.max("prior"), F.lit(1))
    return t.groupBy("term").agg(F.count("*").alias("documents"), F.sum("citations").alias("citations"), recent.alias("recent_documents"), F.round(burst, 6).alias("burst_score"))


def overview(records: DataFrame) -> DataFrame:
    """(metric, value): records, first and last year, citations, records with keywords, authors, references."""
    one = records.agg(
        F.count("*").alias("records"), F.min(F.when(known_year(), F.col("year"))).alias("first_year"), F.max("year").alias("last_year"), F.sum("citations").alias("citations"),
        F.count_if(F.size("keywords") > 0).alias("with_keywords"), F.count_if(F.size("authors") > 0).alias("with_authors"), F.count_if(F.size("refs") > 0).alias("with_references"),
    )
    return one.unpivot([], one.columns, "metric", "value")


def top_cited(records: DataFrame, n: int = 50) -> DataFrame:
    return records.orderBy(F.desc("citations"), "record_id").limit(n).select("record_id", "year", "citations")


def metadata_coverage(records: DataFrame, fields: dict[str, Column], source: str) -> DataFrame:
    """Share of records that have each field, over all and by source."""
    flags = records.select(F.col(source).alias("source"), *[F.coalesce(c, F.lit(False)).cast("int").alias(k) for k, c in fields.items()])
    g = flags.groupingSets([[], ["source"]], "source").agg(F.grouping("source").alias("all_"), F.count("*").alias("total"), *[F.sum(k).alias(k) for k in fields])
    long = g.select("source", "all_", "total", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("available")) for k in fields])).alias("x"))
    return long.select(
        F.when(F.col("all_") == 1, "overall").otherwise("source").alias("scope"), F.when(F.col("all_") == 1, "all").otherwise(F.coalesce("source", F.lit("unknown"))).alias("source"),
        "x.field", "x.available", "total", F.round(F.col("x.available") / F.greatest("total", F.lit(1)), 6).alias("coverage"),
    )


def year_percentile(records: DataFrame) -> DataFrame:
    """Average rank of a record's citations among those of its year, as a share of their number.

    Ranks are those of the distinct numbers of citations of a year, which are few; records only look theirs up.
    """
    held = records.where("year is not null").groupBy(F.col("year").alias("_year"), F.col("citations").alias("_citations")).agg(F.count("*").alias("_n"))
    by = W.partitionBy("_year")
    before = F.coalesce(F.sum("_n").over(by.orderBy("_citations").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = held.select("_year", "_citations", F.round((before + 1 + (F.col("_n") - 1) / 2) / F.sum("_n").over(by), 6).alias("percentile"))
    same = (F.col("year") == F.col("_year")) & F.col("citations").eqNullSafe(F.col("_citations"))
    return records.select("record_id", "year", "citations").join(ranks, same, "left").drop("_year", "_citations")


def frontier(records: DataFrame, weight: Column) -> DataFrame:
    """Twice the recency, the topic weight, and a fifth of the log of the citations."""
    last = records.agg(F.coalesce(F.max("year"), F.lit(0)).alias("last"))
    recency = F.greatest(F.lit(0.0), 1 - (F.col("last") - F.coalesce("year", "last")) / 5)
    r = records.withColumn("_w", F.coalesce(weight, F.lit(0.0))).crossJoin(F.broadcast(last))
    return r.select("record_id", "year", "citations", F.round(recency, 4).alias("recency_score"), F.round("_w", 4).alias("topic_signal"), F.round(recency * 2 + F.col("_w") + F.log1p("citations") / 5, 4).alias("frontier_score"))


def balanced_select(records: DataFrame, limit: int) -> DataFrame:
    """One record of each (topic, five years) after the other, the best of a group first, up to ``limit``."""
    group = F.concat_ws(":", F.coalesce(F.col("topic_id").cast("string"), F.lit("none")), F.coalesce((F.floor(F.col("year") / 5) * 5).cast("string"), F.lit("0")))
    r = records.withColumn("grp", group)
    turn = F.row_number().over(W.partitionBy("grp").orderBy(F.desc("citations"), F.desc("year"), "record_id"))
    return r.withColumn("turn", turn.cast("long")).where(F.col("turn") <= limit).orderBy("turn", "grp").limit(limit).select("record_id", "grp", "turn")


def coverage_targets(records: DataFrame, quota: int, minimum: int) -> DataFrame:
    """The first ``quota`` records of each topic by tier and citations, then others by the same order up to ``minimum``."""
    own = W.partitionBy("topic_id").orderBy("tier", F.desc("citations"), "record_id")
    ranked = records.withColumn("place", F.row_number().over(own))
    first = ranked.where(F.col("place") <= quota)
    n = first.agg(F.count("*").alias("n"))
    fill = ranked.where(F.col("place") > quota).orderBy("tier", F.desc("citations"), "record_id").limit(minimum)
    fill = fill.withColumn("at", F.row_number().over(W.orderBy("tier", F.desc("citations"), "record_id"))).crossJoin(F.broadcast(n)).where(F.col("at") <= minimum - F.col("n"))
    return first.select("record_id", "topic_id", F.lit("quota").alias("why")).unionByName(fill.select("record_id", "topic_id", F.lit("fill").alias("why")))


def citation_minimum(n: Column) -> Column:
    """How many of n works a text must cite at least."""
    some = F.ceil(0.6 * n)
    return F.when(n <= 100, some).otherwise(F.least(n, F.greatest(F.ceil(F.greatest(F.lit(40.0), 5 * F.sqrt(n))), F.least(F.lit(120), some)))).cast("long")


def topic_quota(size: Column, total: Column, least: int = 3, small: int = 100, share: float = 0.6) -> Column:
    """How many of a topic's ``size`` works a text must cite: its share of the minimum for all ``total`` works, three at least, no more than there are."""
    by_size = F.ceil(share * size)
    by_minimum = F.ceil(citation_minimum(total) * size / F.greatest(total, F.lit(1)))
    return F.least(size, F.greatest(F.lit(least), F.when(total <= small, by_size).otherwise(by_minimum))).cast("long")


def reference_candidates(records: DataFrame, known: DataFrame, n: int = 200) -> DataFrame:
    """The most frequent references that are no record yet."""
    refs = records.select("year", F.explode("refs").alias("key"))
    return refs.join(known.select(F.col("key")).distinct(), "key", "left_anti").groupBy("key").agg(F.count("*").alias("occurrences"), F.max("year").alias("last_year")).orderBy(F.desc("occurrences"), F.desc("last_year"), "key").limit(n)


def context_estimate(records: DataFrame, text: Column, batch: int = 12) -> DataFrame:
    """Tokens that all texts take (a quarter of their characters, one at least) and batches they fill."""
    return records.agg(F.count("*").alias("records"), F.sum(F.greatest(F.lit(1), F.floor(F.char_length(text) / 4))).cast("long").alias("tokens"), F.ceil(F.count("*") / batch).cast("long").alias("batches"))
