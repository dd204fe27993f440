"""Bursts of terms and works over years, by a two-state automaton."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textmining import tfidf

def bursts(df: DataFrame, ratio: float = 2.0, gamma: float = 1.0) -> DataFrame:
    """``df`` (counts, totals, years: arrays of one length) with a row ``b`` (start, end, strength, peak) for each stretch in the burst state.

    The cheapest path of two states is a fold over the years that carries the cost of being in either and, for each year, by which
    state each was reached; a second fold goes back along that. Emission costs are binomial without their coefficient; going
    into the burst state costs gamma ln(years); of equal costs the base state is taken. The strength adds up what the burst state saves in
    each year, if anything; the peak is the first year of the most counts. Fewer than two counts, or no chances, have no bursts.
    """
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    d = df.withColumn("_seen", add("counts")).withColumn("_all", add("totals")).where("_seen >= 2 and _all > 0")
    d = d.withColumn("_base", F.least(F.greatest(F.col("_seen") / F.col("_all"), F.lit(1e-6)), F.lit(0.999999)))
    d = d.withColumn("_high", F.least(F.col("_base") * ratio, F.lit(0.999999))).withColumn("_into", gamma * F.log(F.greatest(F.size("years"), F.lit(2)).cast("double")))
    logs = [c for p in ("_base", "_high") for c in (F.log(p), F.log(F.greatest(1 - F.col(p), F.lit(1e-9))))]
    d = d.withColumns({f"_log{i}": c for i, c in enumerate(logs)})
    cost = lambda k, m, hit, miss: -(k * F.col(hit) + (m - k) * F.col(miss))
    d = d.withColumn("_cost", F.zip_with("counts", "totals", lambda k, m: F.struct(cost(k, m, "_log0", "_log1").alias("quiet"), cost(k, m, "_log2", "_log3").alias("loud"))))

    first, into = F.get("_cost", F.lit(0)), F.col("_into")
    start = F.struct(first["quiet"].alias("low"), (first["loud"] + into).alias("high"), F.array().cast("array<struct<low:int,high:int>>").alias("came"))
    by = lambda stays: F.when(stays, 0).otherwise(1)
    step = lambda s, x: F.struct(
        (F.least(s["low"], s["high"]) + x["quiet"]).alias("low"), (F.least(s["low"] + into, s["high"]) + x["loud"]).alias("high"),
        F.array_append(s["came"], F.struct(by(s["low"] <= s["high"]).alias("low"), by(s["low"] + into <= s["high"]).alias("high"))).alias("came"),
    )
    d = d.withColumn("_walk", F.aggregate(F.slice("_cost", F.lit(2), F.size("_cost")), start, step))
    last = F.array(by(F.col("_walk.low") <= F.col("_walk.high")))
    back = lambda path, came: F.array_append(path, F.when(F.element_at(path, -1) == 0, came["low"]).otherwise(came["high"]))
    d = d.withColumn("_path", F.reverse(F.aggregate(F.reverse(F.col("_walk.came")), last, back)))

    on = lambda i: F.coalesce(F.get("_path", i), F.lit(0)) == 1
    places = F.sequence(F.lit(0), F.size("_path") - 1)
    d = d.withColumn("_starts", F.filter(places, lambda i: on(i) & ~on(i - 1))).withColumn("_ends", F.filter(places, lambda i: on(i) & ~on(i + 1)))
    d = d.withColumn("_i", F.explode(F.arrays_zip("_starts", "_ends"))).withColumn("_from", F.col("_i._starts")).withColumn("_n", F.col("_i._ends") - F.col("_from") + 1)
    part = lambda c: F.slice(c, F.col("_from") + 1, F.col("_n"))
    gain = F.aggregate(part("_cost"), F.lit(0.0), lambda s, x: s + F.greatest(F.lit(0.0), x["quiet"] - x["loud"]))
    d = d.withColumn("_part", part("counts"))
    peak = F.col("_from") + F.array_position("_part", F.array_max("_part")).cast("int") - 1
    year = lambda i: F.get("years", i).cast("long")
    b = F.struct(year(F.col("_from")).alias("start"), year(F.col("_i._ends")).alias("end"), F.round(gain, 6).alias("strength"), year(peak).alias("peak"))
    return d.select(*df.columns, b.alias("b"))


def term_bursts(records: DataFrame, terms: str = "keywords", min_docs: int = 3) -> DataFrame:
    """(term, documents, start, end, duration, strength, peak, uncertainty) over the years that occur, of which there must be four.

    One row for each term, holding its counts as an array as long as the list of years, goes to the automaton.
    """
    r = records.where("year is not null and year <> 0").select("record_id", "year", F.array_distinct(terms).alias("t"))
    per_year = r.groupBy("year").agg(F.count("*").alias("total"))
    line = per_year.agg(F.array_sort(F.collect_list(F.struct("year", "total"))).alias("line"))
    per = r.select("year", F.explode("t").alias("term")).groupBy("term", "year").agg(F.count("*").alias("n"))
    maps = per.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("year", "n"))).alias("m"), F.sum("n").alias("documents")).where(F.col("documents") >= min_docs)
    wide = maps.crossJoin(F.broadcast(line)).select("term", "documents", F.transform("line", lambda x: x["year"]).alias("years"), F.transform("line", lambda x: x["total"]).alias("totals"), F.transform("line", lambda x: F.coalesce(F.try_element_at("m", x["year"]), F.lit(0))).alias("counts"))

    x = bursts(wide.where(F.size("years") >= 4)).select("term", "documents", "b.*")
    return x.select("term", "documents", "start", "end", (F.col("end") - F.col("start") + 1).alias("duration"), "strength", "peak", F.when((F.col("documents") >= 10) & (F.col("end") > F.col("start")), "moderate").otherwise("high").alias("uncertainty"))


def burst_support(records: DataFrame, bursts: DataFrame, terms: str = "keywords", most: int = 20) -> DataFrame:
    """Per burst the smallest ids of its records within its years, and how many there are."""
    r = records.select("record_id", "year", F.explode(F.array_distinct(terms)).alias("term"))
    hit = r.join(bursts.select("term", "start", "end"), "term").where("year between start and end")
    return hit.groupBy("term", "start", "end").agg(F.count("*").alias("supporting"), F.array_join(F.slice(F.array_sort(F.collect_set("record_id")), 1, most).cast("array<string>"), "; ").alias("supporting_documents"))


def burst_topics(records: DataFrame, bursts: DataFrame, assignments: DataFrame, terms: str = "keywords", most: int = 20) -> DataFrame:
    """``burst_support`` with the distinct topics (record_id, topic_id) of all supporting records."""
    r = records.select("record_id", "year", F.explode(F.array_distinct(terms)).alias("term"))
    hit = r.join(bursts.select("term", "start", "end"), "term").where("year between start and end").join(assignments.select("record_id", "topic_id"), "record_id")
    topics = hit.groupBy("term", "start", "end").agg(F.array_join(F.array_sort(F.collect_set("topic_id")).cast("array<string>"), "; ").alias("topic_ids"))
    return burst_support(records, bursts, terms, most).join(topics, ["term", "start", "end"], "left").fillna("", "topic_ids")


def phrases(tokens: DataFrame, min_length: int = 5, most: int = 25) -> DataFrame:
    """(record_id, phrases): the heaviest two- to four-word phrases of each record (record_id, tokens), of five letters or more."""
    n = tokens.count()
    top = tfidf(tokens, "tokens", low=2, high=4, most_features=5000, min_df=2 if n >= 20 else 1, max_df=1.0, sublinear=False, top=most)
    return top.where(F.char_length("term") >= min_length).groupBy("record_id").agg(F.array_sort(F.collect_list("term")).alias("phrases"))


def examples(records: DataFrame, terms: DataFrame, text: Column, most: int = 350) -> DataFrame:
    """(term, representative_context): of the smallest id among a term's records (record_id, term) the first sentence that holds it."""
    first = terms.groupBy("term").agg(F.min("record_id").alias("record_id"))
    r = first.join(records.select("record_id", F.col("title"), text.alias("_text")), "record_id")
    hits = F.filter(F.split("_text", r"(?<=[.!?。！？])\s*"), lambda s: F.contains(F.lower(s), F.lower(F.col("term"))))
    return r.select("term", F.substring(F.coalesce(F.trim(F.get(hits, F.lit(0))), F.col("title"), F.lit("")), 1, most).alias("representative_context"))


def citation_bursts(histories: DataFrame) -> DataFrame:
    """(record_id, start, end, duration, strength, peak, uncertainty) of works with a history (year → citations) of four years or more.

    The chances of every year are all citations of the work.
    """
    e = F.array_sort(F.map_entries("history"))
    h = histories.select("record_id", F.transform(e, lambda x: x["key"].cast("long")).alias("years"), F.transform(e, lambda x: F.coalesce(x["value"], F.lit(0)).cast("long")).alias("counts")).where(F.size("years") >= 4)
    h = h.withColumn("total", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x))
    h = h.withColumn("totals", F.transform("counts", lambda _: F.greatest("total", F.lit(1))))
    x = bursts(h).select("record_id", "total", "b.*")
    return x.select("record_id", "start", "end", (F.col("end") - F.col("start") + 1).alias("duration"), "strength", "peak", F.when((F.col("total") >= 10) & (F.col("end") > F.col("start")), "moderate").otherwise("high").alias("uncertainty"))


def citation_roles(histories: DataFrame) -> DataFrame:
    """(record_id, role) from yearly citations (record_id, year, citations, history map) and the latest year of all."""
    last = histories.agg(F.coalesce(F.max("year"), F.lit(0)).alias("last"))
    h = histories.crossJoin(F.broadcast(last))
    e = F.map_entries("history")
    total = lambda keep: F.aggregate(F.filter(e, keep), F.lit(0).cast("long"), lambda s, x: s + x["value"])
    h = h.withColumn("_recent", total(lambda x: x["key"] >= F.col("last") - 2)).withColumn("_earlier", total(lambda x: x["key"] < F.col("last") - 2)).withColumn("_active", F.size(F.filter(e, lambda x: x["value"] > 0)))
    old, some = F.col("last") - F.col("year") >= 8, F.coalesce(F.size("history") > 0, F.lit(False))
    role = (
        F.when(some & old & (F.col("_recent") > F.greatest("_earlier", F.lit(1))), "rediscovery-candidate")
        .when(some & (F.col("year") >= F.col("last") - 3) & (F.col("_recent") >= F.greatest(F.lit(3), F.col("_earlier") * 2)), "short-wave-or-frontier")
        .when(some & old & (F.col("_active") >= 4), "sustained-classic")
        .when(some, "unclassified")
        .when((F.col("year") <= F.col("last") - 8) & (F.col("citations") > 0), "early-high-impact-candidate")
        .when(F.col("year") >= F.col("last") - 3, "recent-growth-candidate")
        .otherwise("unclassified")
    )
    return h.select("record_id", "year", F.coalesce("citations", F.lit(0)).alias("citations"), role.alias("role"), some.alias("annual_history_available"))
