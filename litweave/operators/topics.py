"""Topics over time, between works, and against other groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import hold


def topic_trends(records: DataFrame) -> DataFrame:
    return records.where("year is not null and year <> 0 and topic_id is not null").groupBy("year", "topic_id").agg(F.count("*").alias("documents"))


def topic_lifecycle(trends: DataFrame) -> DataFrame:
    """Per topic first and last year, documents of the last three years and before, and its stage."""
    last = trends.agg(F.max("year").alias("last"))
    t = trends.crossJoin(F.broadcast(last))
    recent, prior = F.sum(F.when(F.col("year") >= F.col("last") - 2, F.col("documents")).otherwise(0)), F.sum(F.when(F.col("year") < F.col("last") - 2, F.col("documents")).otherwise(0))
    g = t.groupBy("topic_id").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), recent.alias("recent_documents"), prior.alias("prior_documents"))
    stage = F.when(F.col("recent_documents") >= F.greatest(F.lit(2), "prior_documents"), "emerging").when(F.col("recent_documents") == 0, "declining").otherwise("established")
    return g.withColumn("stage", stage)


def topic_evolution(trends: DataFrame) -> DataFrame:
    """Flow of a topic between five-year periods that follow each other among those that occur."""
    t = trends.groupBy((F.floor(F.col("year") / 5) * 5).alias("p"), "topic_id").agg(F.sum("documents").alias("n"))
    following = t.select("p").distinct().withColumn("to", F.lead("p").over(W.orderBy("p"))).where("to is not null")
    b = t.select(F.col("p").alias("to"), "topic_id", F.col("n").alias("target_documents"))
    label = lambda c: F.concat_ws("-", F.col(c).cast("string"), (F.col(c) + 4).cast("string"))
    return t.join(following, "p").join(b, ["to", "topic_id"]).select(label("p").alias("source_period"), label("to").alias("target_period"), "topic_id", F.least("n", "target_documents").alias("flow_weight"), F.col("n").alias("source_documents"), "target_documents")


def gap_candidates(records: DataFrame, fulltext: str) -> DataFrame:
    """Per topic its documents, years, full texts, and how strong evidence on it is."""
    g = records.where("topic_id is not null").groupBy("topic_id").agg(F.count("*").alias("documents"), F.min("year").alias("year_min"), F.max("year").alias("year_max"), F.count_if(F.expr(fulltext)).alias("fulltext_documents"))
    return g.select(F.concat(F.lit("G"), F.lpad(F.col("topic_id").cast("string"), 3, "0")).alias("gap_id"), "*", F.when((F.col("documents") < 5) | (F.col("fulltext_documents") == 0), "low").otherwise("medium").alias("evidence_strength"))


def medians(counts: DataFrame, scope: list[str], value: str, n: str = "n") -> DataFrame:
    """(*scope, median): exact medians from how often each value occurs, by the two values in the middle.

    The rows behind the counts are never brought together: what is sorted of a scope is its distinct values.
    """
    upto = F.sum(n).over(W.partitionBy(*scope).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow))
    c = counts.withColumn("_upto", upto).join(counts.groupBy(*scope).agg(F.sum(n).alias("_all")), scope)
    middle = lambda place: F.min(F.when(F.col("_upto") >= place, F.col(value)))
    return c.groupBy(*scope).agg(((middle(F.ceil(F.col("_all") / 2)) + middle(F.floor(F.col("_all") / 2) + 1)) / 2).alias("median"))


def citation_age(refs: DataFrame) -> DataFrame:
    """Ages of references (citing year less reference year, none negative), over all and by topic.

    References are counted by topic and age first; all else is read off these counts. The half-life is the median.
    """
    a = refs.where("reference_year <= citing_year").groupBy("topic_id", (F.col("citing_year") - F.col("reference_year")).alias("age")).agg(F.count("*").alias("n"))
    by_topic = a.where("topic_id is not null").select(F.concat(F.lit("topic-"), F.col("topic_id").cast("string")).alias("scope"), "age", "n")
    c = by_topic.unionByName(a.groupBy("age").agg(F.sum("n").alias("n")).select(F.lit("all").alias("scope"), "age", "n"))
    g = c.groupBy("scope").agg(F.sum("n").alias("references"), F.round(F.sum(F.col("age") * F.col("n")) / F.sum("n"), 6).alias("mean_age"), F.round(F.sum(F.when(F.col("age") <= 5, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("recent_reference_share_5y"))
    return g.join(medians(c, ["scope"], "age"), "scope").select("scope", "references", F.col("median").alias("median_age"), "mean_age", F.col("median").alias("synchronous_half_life"), "recent_reference_share_5y")


def knowledge_flow(edges: DataFrame, assignments: DataFrame) -> DataFrame:
    """Citations from topic to topic; the source is the topic of the cited work. Flow is scaled by the root of both sizes."""
    t = assignments.where("topic_id is not null").select("record_id", "topic_id")
    sizes = t.groupBy("topic_id").agg(F.count("*").alias("n"))
    e = edges.join(t.select(F.col("record_id").alias("target_id"), F.col("topic_id").alias("source_topic")), "target_id").join(t.select(F.col("record_id").alias("source_id"), F.col("topic_id").alias("target_topic")), "source_id")
    g = e.groupBy("source_topic", "target_topic").agg(F.sum("weight").alias("citation_weight"), F.countDistinct("source_id").alias("independent_citing_documents"))
    g = g.join(sizes.select(F.col("topic_id").alias("source_topic"), F.col("n").alias("na")), "source_topic").join(sizes.select(F.col("topic_id").alias("target_topic"), F.col("n").alias("nb")), "target_topic")
    return g.select("source_topic", "target_topic", "citation_weight", F.round(F.col("citation_weight") / F.sqrt(F.col("na") * F.col("nb")), 6).alias("fractional_flow"), "independent_citing_documents", (F.col("independent_citing_documents") >= 3).alias("eligible"))


def flow_null(edges: DataFrame, assignments: DataFrame, runs: int = 100, seed: int = 42) -> DataFrame:
    """Mean and deviation of the flow over permutations of the topics among the works, and the z-score of the real one.

    A permutation deals the sorted topics to the works in a seeded random order; sizes and edges stay as they are. The
    order is that of a hash, so works are counted in ranges of the hash and no task sees all of them, and a work's topic follows
    from the hashes of the last works of each topic.
    """
    t, edges = hold(assignments.where("topic_id is not null").select("record_id", "topic_id")), hold(edges)
    real = knowledge_flow(edges, t)
    sizes = [(r["topic_id"], r["n"]) for r in t.groupBy("topic_id").agg(F.count("*").alias("n")).orderBy("topic_id").collect()]
    ranges = max(1, sum(n for _, n in sizes) // 10_000)
    order = t.select("record_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long"))).alias("run")).withColumn("h", F.xxhash64("record_id", "run", F.lit(seed)))
    order = order.withColumn("range", F.floor((F.col("h") / 2.0**63 + 1) / 2 * ranges))
    counts = order.groupBy("run", "range").agg(F.count("*").alias("n"))
    before = counts.select("run", "range", "n", (F.sum("n").over(W.partitionBy("run").orderBy("range")) - F.col("n")).alias("before"))
    # only the last place of each topic is looked for, in the range where it is; all others follow by comparing hashes
    ends = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(sum(n for _, n in sizes[: i + 1])).cast("long").alias("k")) for i in range(len(sizes))])
    wanted = before.withColumn("end", F.explode(ends)).where("end.k > before and end.k <= before + n").select("run", "range", "end.i", (F.col("end.k") - F.col("before")).alias("own"))
    near = order.join(F.broadcast(wanted.select("run", "range").distinct()), ["run", "range"])
    near = near.withColumn("own", F.row_number().over(W.partitionBy("run", "range").orderBy("h", "record_id")))
    last = near.join(wanted, ["run", "range", "own"]).groupBy("run").agg(F.array_sort(F.collect_list(F.struct("h", "record_id"))).alias("ends"))
    bounds = hold(last.agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "ends"))), lambda r: r["ends"]).alias("bounds")))
    # the topics of a work in all runs are one array, so that works and edges are shuffled once and not once for each run
    own = lambda run: F.struct(F.xxhash64("record_id", run, F.lit(seed)).alias("h"), F.col("record_id"))
    place = lambda run: F.size(F.filter(F.get("bounds", run.cast("int")), lambda b: b < own(run))).cast("tinyint" if len(sizes) < 128 else "int")
    mixed = t.crossJoin(F.broadcast(bounds)).select("record_id", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long")), place).alias("drawn"))
    e = edges.join(mixed.select(F.col("record_id").alias("target_id"), F.col("drawn").alias("s")), "target_id").join(mixed.select(F.col("record_id").alias("source_id"), F.col("drawn").alias("t")), "source_id")
    e = e.select("weight", "s", "t", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run")).select("run", F.get("s", "run").alias("s"), F.get("t", "run").alias("t"), "weight")
    name = lambda c: F.get(F.array(*[F.lit(x) for x, _ in sizes]), F.col(c).cast("int"))
    per = e.groupBy("run", "s", "t").agg(F.sum("weight").alias("w")).select("run", name("s").alias("source_topic"), name("t").alias("target_topic"), "w")
    null = per.groupBy("source_topic", "target_topic").agg((F.sum("w") / runs).alias("mean"), (F.sum(F.col("w") * F.col("w")) / runs).alias("square"))
    scale = F.col("citation_weight") / F.col("fractional_flow")
    out = real.join(null, ["source_topic", "target_topic"], "left").withColumn("null_mean", F.coalesce("mean", F.lit(0.0)) / scale).withColumn("null_sd", F.sqrt(F.greatest(F.lit(0.0), F.coalesce("square", F.lit(0.0)) - F.pow(F.coalesce("mean", F.lit(0.0)), 2))) / scale)
    out = out.withColumn("null_z", F.when(F.col("null_sd") > 0, (F.col("fractional_flow") - F.col("null_mean")) / F.col("null_sd")))
    good = F.col("eligible") & F.coalesce(F.col("null_z") >= 1.96, F.lit(False))
    return out.select("source_topic", "target_topic", "citation_weight", "fractional_flow", "independent_citing_documents", "null_mean", "null_sd", "null_z", good.alias("writing_eligible"), F.when(good, "moderate").otherwise("high").alias("uncertainty"))


def term_topic(pairs: DataFrame) -> DataFrame:
    """(term, topic_id): the first topic that names a term."""
    return pairs.groupBy(F.lower("term").alias("term")).agg(F.min("topic_id").alias("topic_id"))


def strategic_map(edges: DataFrame, terms: DataFrame, sizes: DataFrame) -> DataFrame:
    """Density within and centrality between topics of weighted term edges, and the quadrant by the medians of both."""
    t = term_topic(terms)
    e = edges.select(F.lower("a").alias("a"), F.lower("b").alias("b"), "weight").join(t.select(F.col("term").alias("a"), F.col("topic_id").alias("ta")), "a").join(t.select(F.col("term").alias("b"), F.col("topic_id").alias("tb")), "b")
    ends = e.select(F.explode(F.when(F.col("ta") == F.col("tb"), F.array(F.struct(F.col("ta").alias("t"), F.col("weight").alias("i"), F.lit(0.0).alias("x")))).otherwise(F.array(*[F.struct(F.col(c).alias("t"), F.lit(0.0).alias("i"), F.col("weight").alias("x")) for c in ("ta", "tb")]))).alias("s"))
    w = ends.groupBy("s.t").agg(F.sum("s.i").alias("inside"), F.sum("s.x").alias("outside"))
    n = t.groupBy("topic_id").agg(F.count("*").alias("terms"))
    possible = F.greatest(F.coalesce("terms", F.lit(0)) * (F.coalesce("terms", F.lit(0)) - 1) / 2, F.lit(1.0))
    m = sizes.join(n, "topic_id", "left").join(w, F.col("topic_id") == F.col("t"), "left").select("topic_id", "documents", F.round(F.coalesce("inside", F.lit(0.0)) / possible, 6).alias("density"), F.round(F.coalesce("outside", F.lit(0.0)), 6).alias("centrality"))
    med = m.agg(F.median("centrality").alias("cm"), F.median("density").alias("dm"))
    c, d = F.col("centrality") >= F.col("cm"), F.col("density") >= F.col("dm")
    return m.crossJoin(F.broadcast(med)).select("topic_id", "documents", "density", "centrality", F.when(c & d, "motor").when(c, "basic").when(d, "niche").otherwise("weakly-developed").alias("quadrant"))


def contingency(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("documents"))


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: number of pairs, adjusted Rand index and normalised mutual information (arithmetic mean) of two groupings."""
    t = contingency(pairs, a, b)
    two = lambda c: c * (c - 1) / 2
    n = t.agg(F.sum("documents").alias("n"))
    x = t.groupBy(a).agg(F.sum("documents").alias("na"))
    y = t.groupBy(b).agg(F.sum("documents").alias("nb"))
    ent = lambda c: -F.sum(c / F.col("n") * F.log(c / F.col("n")))
    sx = x.crossJoin(F.broadcast(n)).agg(F.sum(two(F.col("na"))).alias("px"), ent(F.col("na")).alias("hx"))
    sy = y.crossJoin(F.broadcast(n)).agg(F.sum(two(F.col("nb"))).alias("py"), ent(F.col("nb")).alias("hy"))
    full = t.join(x, a).join(y, b).crossJoin(F.broadcast(n))
    p = F.col("documents") / F.col("n")
    st = full.agg(F.sum(two(F.col("documents"))).alias("pt"), F.sum(p * F.log(p * F.col("n") * F.col("n") / (F.col("na") * F.col("nb")))).alias("mi"), F.max("n").alias("pairs"))
    r = st.crossJoin(sx).crossJoin(sy)
    expected = F.col("px") * F.col("py") / two(F.col("pairs"))
    most = (F.col("px") + F.col("py")) / 2
    ari = F.when(most == expected, 1.0).otherwise((F.col("pt") - expected) / (most - expected))
    nmi = F.when(F.col("hx") + F.col("hy") == 0, 1.0).otherwise(2 * F.col("mi") / (F.col("hx") + F.col("hy")))
    return r.select("pairs", F.round(ari, 6).alias("ari"), F.round(nmi, 6).alias("nmi"))


def quadrant_stability(positions: DataFrame, runs: int = 200, seed: int = 42) -> DataFrame:
    """``strategic_map`` with ``stability``: the share of seeded draws around a topic's position that stay in its quadrant.

    Centrality varies by its root, density by 15 %; the medians stay. Draws are normal, from hashes of topic and run.
    """
    med = positions.agg(F.median("centrality").alias("cm"), F.median("density").alias("dm"))
    uniform = lambda k: (F.pmod(F.xxhash64("topic_id", "run", F.lit(seed), F.lit(k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    d = positions.crossJoin(F.broadcast(med)).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    radius, angle = F.sqrt(-2 * F.log(uniform(1))), 2 * F.pi() * uniform(2)
    c = F.greatest(F.lit(0.0), F.col("centrality") + radius * F.cos(angle) * F.greatest(F.sqrt("centrality"), F.lit(0.01)))
    y = F.greatest(F.lit(0.0), F.col("density") + radius * F.sin(angle) * F.greatest(F.col("density") * 0.15, F.lit(0.001)))
    right, up = c >= F.col("cm"), y >= F.col("dm")
    drawn = F.when(right & up, "motor").when(right, "basic").when(up, "niche").otherwise("weakly-developed")
    share = d.groupBy("topic_id").agg(F.round(F.avg((drawn == F.col("quadrant")).cast("double")), 6).alias("stability"))
    return positions.join(share, "topic_id")
