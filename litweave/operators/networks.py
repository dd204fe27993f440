"""Edges between terms, authors, works and references, and measures of the graphs they make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import DOI, normalize_doi
from ..storage import hold

#: Pairs of records that are counted in one task.
PAIRS = 2_000_000


def cooccurrence(records: DataFrame, items: str, most: int | None, fractional: bool = True) -> DataFrame:
    """(a, b, weight): pairs of the first ``most`` distinct items of a record, by value; None: of all.

    Each record adds 1, or 1 / (n - 1) if fractional. Records are first reduced to counts for each pair and list
    length, so that sums do not depend on the order of the records.
    """
    own = F.array_sort(F.array_distinct(items))
    lists = records.select((own if most is None else F.slice(own, 1, most)).alias("i")).where(F.size("i") > 1)
    pairs = lists.select(F.size("i").alias("n"), F.posexplode("i").alias("k", "a"), "i").select("n", "a", F.explode(F.slice("i", F.col("k") + 2, F.size("i"))).alias("b"))
    counted = pairs.groupBy("a", "b", "n").agg(F.count("*").alias("c"))
    weight = F.sum(F.col("c") / (F.col("n") - 1)) if fractional else F.sum("c")
    return counted.groupBy("a", "b").agg((F.round(weight, 6) if fractional else weight).alias("weight"))


def raw_references(records: DataFrame, refs: str = "references") -> DataFrame:
    """(record_id, doi, openalex) of records' references as text: the DOI and the OpenAlex number that stand in it."""
    doi = normalize_doi(F.regexp_extract("r", DOI, 0))
    return records.select("record_id", F.explode(refs).alias("r")).select("record_id", F.nullif(doi, F.lit("")).alias("doi"), F.nullif(F.regexp_extract("r", r"W\d+", 0), F.lit("")).alias("openalex"))


def citation_edges(records: DataFrame, refs: DataFrame) -> DataFrame:
    """(source_id, target_id, weight): references resolved by DOI, else by OpenAlex number; a work does not cite itself."""
    dois = records.where("doi is not null and doi <> ''").groupBy("doi").agg(F.max("record_id").alias("by_doi"))
    oas = records.where("openalex is not null and openalex <> ''").groupBy("openalex").agg(F.max("record_id").alias("by_oa"))
    r = refs.join(dois, "doi", "left").join(oas, "openalex", "left").select("record_id", F.coalesce("by_doi", "by_oa").alias("target_id"))
    return r.where("target_id is not null and target_id <> record_id").groupBy(F.col("record_id").alias("source_id"), "target_id").agg(F.count("*").alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """(record_id, local_citations, references_in_corpus) of directed edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("target_id").alias("record_id"), F.col("weight").alias("i"), F.lit(0).cast("long").alias("o")), F.struct(F.col("source_id").alias("record_id"), F.lit(0).cast("long").alias("i"), F.col("weight").alias("o")))).alias("x"))
    return ends.groupBy("x.record_id").agg(F.sum("x.i").alias("local_citations"), F.sum("x.o").alias("references_in_corpus"))


def bibliographic_coupling(records: DataFrame, refs: str = "refs", least: int = 1, block: int = 2_000) -> DataFrame:
    """Pairs of records with the number of references they share, if ``least`` or more, by an inverted index.

    The records of a reference are dealt into blocks, and each pair of blocks is a key of its own, so that a reference
    that very many records share is the work of many tasks. A record meets the later ones of a block as one list, so that what is shuffled
    is a number for each pair; lists go to their record, in so many partitions that PAIRS pairs are counted in one, and are counted there.
    Where all pairs of such a reference are too many, raise ``least``.
    """
    r = records.select("record_id", F.explode(F.array_distinct(refs)).alias("ref")).where("ref is not null")
    counts = r.groupBy("ref").agg(F.count("*").alias("n")).where("n > 1")
    parts = int(counts.agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2)).first()[0] or 0) // PAIRS + 1
    m = r.join(counts.select("ref", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "ref").withColumn("own", F.pmod(F.xxhash64("record_id", F.lit(3)), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    lists = m.groupBy("ref", "own", "blocks").agg(F.sort_array(F.collect_list("record_id")).alias("ys")).select("ref", F.col("own").alias("j"), "ys", every.alias("i"))
    guests = m.select("ref", F.col("own").alias("i"), F.col("record_id").alias("x"), every.alias("j"))
    later = guests.join(lists, ["ref", "i", "j"]).select("x", F.filter("ys", lambda y: y > F.col("x")).alias("ys")).where("size(ys) > 0")
    parts = max(parts, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = later.repartition(parts, "x").select(F.col("x").alias("record_a"), F.explode("ys").alias("record_b"))
    return pairs.groupBy("record_a", "record_b").agg(F.count("*").alias("shared_references")).where(F.col("shared_references") >= least)


def co_citation(records: DataFrame, refs: str = "refs", most: int = 80) -> DataFrame:
    """Pairs of references with the number of records that have both among their first ``most`` by value."""
    return cooccurrence(records, refs, most, fractional=False).select(F.col("a").alias("reference_a"), F.col("b").alias("reference_b"), F.col("weight").alias("co_citations"))


def both_ways(edges: DataFrame) -> DataFrame:
    e = edges.select("a", "b", "weight")
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def backbone(edges: DataFrame, most_edges: int = 3000, most_nodes: int = 250) -> DataFrame:
    """The heaviest edges, and of those the ones between the nodes of the largest weighted degree."""
    top = hold(edges.orderBy(F.desc("weight"), "a", "b").limit(most_edges))  # read three times
    nodes = both_ways(top).groupBy("a").agg(F.round(F.sum("weight"), 6).alias("d")).orderBy(F.desc("d"), "a").limit(most_nodes).select(F.col("a").alias("node"))
    return top.join(nodes, top["a"] == nodes["node"], "left_semi").join(nodes, top["b"] == nodes["node"], "left_semi")


def density_and_clustering(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, triangles and the mean local clustering of an undirected graph."""
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    deg = e.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    f, g = e.select(F.col("a").alias("x"), F.col("b").alias("y")), e.select(F.col("a").alias("u"), F.col("b").alias("v"))
    tri = e.join(f, e["b"] == f["x"]).join(g, (F.col("u") == F.col("a")) & (F.col("v") == F.col("y"))).select("a", "b", F.col("y").alias("c"))
    own = tri.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("t"))
    local = deg.join(own, "node", "left").select("d", F.coalesce("t", F.lit(0)).alias("t")).withColumn("c", F.when(F.col("d") > 1, 2 * F.col("t") / (F.col("d") * (F.col("d") - 1))).otherwise(0.0))
    return local.agg(
        F.count("*").alias("nodes"), (F.sum("d") / 2).cast("long").alias("edges"), F.round(F.sum("d") / (F.count("*") * (F.count("*") - 1)), 8).alias("density"),
        (F.sum("t") / 3).cast("long").alias("triangles"), F.round(F.avg("c"), 8).alias("average_clustering"),
    )


def participation(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Per node (node, community): strength, participation, and strength within its community as a z-score."""
    both = both_ways(edges)
    g = groups.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    by = both.join(g, "b").groupBy("a", "cb").agg(F.sum("weight").alias("w"))
    s = by.groupBy("a").agg(F.sum("w").alias("strength"), (1 - F.sum(F.pow(F.col("w"), 2)) / F.pow(F.sum("w"), 2)).alias("participation"))
    own = groups.join(by, (F.col("node") == F.col("a")) & (F.col("community") == F.col("cb")), "left").select("node", "community", F.coalesce("w", F.lit(0.0)).alias("inside"))
    peers = own.groupBy(F.col("community").alias("of")).agg(F.avg("inside").alias("mean"), F.stddev_pop("inside").alias("sd"))
    z = F.when(F.col("sd") > 1e-12, (F.col("inside") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    out = own.join(peers, F.col("community").eqNullSafe(F.col("of"))).withColumn("z", z).join(s, F.col("node") == F.col("a"), "left")
    return out.select("node", "community", F.round(F.coalesce("strength", F.lit(0.0)), 6).alias("strength"), F.round(F.coalesce("participation", F.lit(0.0)), 6).alias("participation"), F.round("z", 6).alias("within_z"))


def constraint(edges: DataFrame) -> DataFrame:
    """Burt's constraint, and effective size, of every node of an undirected weighted graph."""
    both = both_ways(edges)
    p = both.withColumn("p", F.col("weight") / F.sum("weight").over(W.partitionBy("a"))).withColumn("m", F.col("weight") / F.max("weight").over(W.partitionBy("a"))).select("a", "b", "p", "m")
    q = p.select(F.col("a").alias("q"), F.col("b").alias("j"), F.col("p").alias("pq"))
    two = p.select(F.col("a").alias("i"), F.col("b").alias("q"), "p").join(q, "q").where("i <> j").groupBy("i", "j").agg(F.sum(F.col("p") * F.col("pq")).alias("way"))
    c = p.join(two, (F.col("a") == F.col("i")) & (F.col("b") == F.col("j")), "left").groupBy("a").agg(F.sum(F.pow(F.col("p") + F.coalesce("way", F.lit(0.0)), 2)).alias("constraint"))
    m = p.select(F.col("a").alias("j"), F.col("b").alias("q"), F.col("m").alias("mq"))
    red = p.select(F.col("a").alias("i"), F.col("b").alias("q"), "p").join(m, "q").where("i <> j")
    held = red.join(p.select(F.col("a").alias("i"), F.col("b").alias("j")), ["i", "j"], "left_semi").groupBy("i").agg(F.sum(F.col("p") * F.col("mq")).alias("r"))
    size = p.groupBy("a").agg(F.count("*").alias("n")).join(held, F.col("a") == F.col("i"), "left").select("a", (F.col("n") - F.coalesce("r", F.lit(0.0))).alias("effective_size"))
    return c.join(size, "a").select(F.col("a").alias("node"), F.round("constraint", 6).alias("constraint"), F.round("effective_size", 6).alias("effective_size"))


def effective_sizes(edges: DataFrame) -> DataFrame:
    """(node, effective_size) as in ``constraint``, of graphs of any size: what is redundant is added up over triangles, not over all ways of two edges."""
    from .vertices import closed

    both = both_ways(edges)
    own = both.groupBy("a").agg(F.count("*").alias("n"), F.sum("weight").alias("s"), F.max("weight").alias("top"))
    t = closed(edges.select(F.lit("").alias("network"), "a", "b", F.col("weight").alias("w")))
    # a third node q is redundant to i by the share of q in i and the strength of q's tie to j
    ways = F.explode(F.array(*[F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.col(iq).alias("iq"), F.col(jq).alias("jq")) for i, j, iq, jq in (("a", "b", "ac", "bc"), ("b", "a", "bc", "ac"), ("a", "c", "ab", "bc"), ("c", "a", "bc", "ab"), ("b", "c", "ab", "ac"), ("c", "b", "ac", "ab"))]))
    red = t.select(ways.alias("x")).select("x.*").join(own.select(F.col("a").alias("j"), "top"), "j").groupBy("i").agg(F.sum(F.col("iq") * F.col("jq") / F.col("top")).alias("r"))
    size = F.col("n") - F.coalesce(F.col("r") / F.col("s"), F.lit(0.0))
    return own.join(red, F.col("a") == F.col("i"), "left").select(F.col("a").alias("node"), F.round(size, 6).alias("effective_size"))


def threshold_sensitivity(edges: DataFrame, levels=(1, 2, 3)) -> DataFrame:
    """Edges, nodes and density of the graph above each weight."""
    e = edges.select("a", "b", "weight", F.explode(F.array(*map(F.lit, levels))).alias("threshold")).where("weight >= threshold")
    nodes = e.select("threshold", F.explode(F.array("a", "b")).alias("n")).groupBy("threshold").agg(F.countDistinct("n").alias("nodes"))
    return e.groupBy("threshold").agg(F.count("*").alias("edges")).join(nodes, "threshold").select(F.col("threshold").cast("long").alias("threshold"), "edges", "nodes", F.round(2 * F.col("edges") / (F.col("nodes") * F.greatest(F.col("nodes") - 1, F.lit(1))), 8).alias("density"))


def structural_holes(nodes: DataFrame, edges: DataFrame, most: int = 30) -> DataFrame:
    """Pairs of brokers of different communities without an edge, by (effective sizes) * (participations + 0.1)."""
    top = nodes.orderBy(F.desc("effective_size"), "node").limit(most)
    a, b = (top.select(*[F.col(c).alias(f"{c}_{x}") for c in ("node", "community", "effective_size", "participation")]) for x in "ab")
    pairs = a.join(b, (F.col("node_a") < F.col("node_b")) & (F.col("community_a") != F.col("community_b")))
    linked = edges.select(F.least("a", "b").alias("node_a"), F.greatest("a", "b").alias("node_b"))
    score = (F.col("effective_size_a") + F.col("effective_size_b")) * (F.col("participation_a") + F.col("participation_b") + 0.1)
    return pairs.join(linked, ["node_a", "node_b"], "left_anti").select("node_a", "node_b", F.round(score, 6).alias("score"))
