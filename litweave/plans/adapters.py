"""The star-schema and text tables as bibliographic records, in Spark and as common table expressions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a table for each partition of what is shuffled from it.
PART_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    fit_shuffles(spark, path)
    return spark.read.parquet(path)


def fit_shuffles(spark: SparkSession, path: str) -> None:
    """Raises the session's number of shuffle partitions with the size of what it reads, so that the memory of one task does not grow with the input.

    Partitions are merged to at most PART_BYTES only, also where there are enough of them already; a number that is set higher, and a size that is set lower, stay.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    parts = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength() // PART_BYTES
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    if parts:
        merged = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
        if spark._jsparkSession.sessionState().conf().getConfString(merged, "64m") in ("64m", "64MB", str(64 << 20), f"{64 << 20}b"):
            spark.conf.set(merged, f"{PART_BYTES}b")


def orders_as_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as works: suppliers are authors, parts are references, words of part names are keywords.

    Lines meet the parts for keywords and topics only; a query that reads neither is spared that join.
    """
    o = table(spark, sf_dir, "orders")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    lists = line.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("authors"), F.sort_array(F.collect_set("l_partkey")).alias("refs"))
    named = line.join(part, line["l_partkey"] == part["p_partkey"], "left").groupBy(F.col("l_orderkey").alias("n_orderkey")).agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.array_append(F.split(F.lower("p_name"), " "), F.lower("p_type")))))).alias("keywords"),
        (F.min_by("p_size", "l_partkey") % 6 + 1).cast("long").alias("topic_id"),
    )
    return o.join(lists, o["o_orderkey"] == lists["l_orderkey"], "left").join(named, o["o_orderkey"] == named["n_orderkey"], "left").select(
        F.col("o_orderkey").alias("record_id"), F.year("o_orderdate").cast("long").alias("year"), F.col("o_orderstatus").alias("type"),
        F.col("o_orderpriority").alias("venue"), F.floor(F.col("o_totalprice") / 1000).cast("long").alias("citations"), "authors", "refs", "keywords", "topic_id",
    )


ORDERS = """
lines as (select distinct l_orderkey, l_partkey, l_suppkey, lower(p_name) as p_name, lower(p_type) as p_type, p_size from lineitem left join part on l_partkey = p_partkey),
works as (
  select o_orderkey as record_id, cast(year(o_orderdate) as bigint) as year, o_orderstatus as type, o_orderpriority as venue, cast(floor(o_totalprice / 1000) as bigint) as citations,
         (select cast(arg_min(p_size, l_partkey) % 6 + 1 as bigint) from lines where l_orderkey = o_orderkey) as topic_id
  from orders),
authors as (select distinct l_orderkey as record_id, l_suppkey as author from lines),
refs as (select distinct l_orderkey as record_id, l_partkey as ref from lines),
keywords as (select distinct l_orderkey as record_id, unnest(list_append(string_split(p_name, ' '), p_type)) as keyword from lines)
"""


def self_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works that cite works: a line's part number read as an order number, with the number of such lines."""
    line, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return line.join(o, line["l_partkey"] == o["o_orderkey"], "left_semi").where("l_partkey <> l_orderkey").groupBy(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id")).agg(F.count("*").alias("weight"))


SELF = "edges as (select l_orderkey as source_id, l_partkey as target_id, count(*) as weight from lineitem where l_partkey in (select o_orderkey from orders) and l_partkey <> l_orderkey group by 1, 2)"


def documents_as_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as works: the first 120 characters are the title, the text is the abstract."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("record_id"), F.substring("text", 1, 120).alias("title"), F.col("text").alias("abstract"), F.col("lang").alias("language"), F.col("source").alias("venue"),
        (2000 + F.col("doc_id") % 24).alias("year"), (F.col("n_chars") % 97).alias("citations"),
    )


DOCS = "docs as (select doc_id as record_id, substr(text, 1, 120) as title, text as abstract, lang as language, source as venue, 2000 + doc_id % 24 as year, n_chars % 97 as citations from documents)"
