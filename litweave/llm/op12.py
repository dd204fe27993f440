"""Query op12_prefix_trie: the trie of all conversations, each rebuilt on the first turns of another, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .prefix_trie import CHUNK, numbered_turns, trie

#: A conversation takes fewer than SPANS first turns from the first of its run of EVERY ids.
EVERY, SPANS = 5, 9


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations (conv_id, place, a, b, bytes) of ``turns``, and all ids (conv_id).

    Rows of a long conversation are joined in chunks of CHUNK places.
    """
    counts = turns.groupBy("conv_id").agg(F.max("place").alias("n"))
    of = counts.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % EVERY).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SPANS).alias("h"))
    of = of.join(counts.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    of = cut(of.withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0).cast("long")))))
    first = turns.where(F.col("place") < SPANS).withColumnRenamed("conv_id", "base").join(of.select("conv_id", "base", "h"), "base").where("place <= h")
    spread = of.select("conv_id", "h", "taken", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / CHUNK))).alias("chunk"))
    own = turns.withColumn("chunk", F.floor(F.col("place") / CHUNK)).join(spread, ["conv_id", "chunk"]).where("place > h")
    own = own.withColumn("place", F.col("place") - F.col("h") + F.col("taken"))
    want = ["conv_id", "place", "a", "b", "bytes"]
    return first.select(*want).unionByName(own.select(*want)), of.select("conv_id")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(cut(numbered_turns(table(spark, sf_dir, "conversations")))))


#: Every node as the list of its turns, and every pair of a node and one above it; checksums by shifts of their bits.
SQL = rf"""
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) as i
  from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % {EVERY} as base, cast(conv_id as varchar) as s, list(struct_pack(r := role, x := text) order by i) as own from t group by conv_id),
k as (
  select *, (4294967295 - list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len(s) + 1), lambda j: ascii(s[j])::bigint)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda v, _: xor(v >> 1, case when v & 1 = 1 then 3988292384 else 0 end)))) % {SPANS} as h
  from c),
r as (select k.conv_id, list_concat(coalesce(b.own[1:k.h], []), k.own[k.h + 1:]) as way from k left join c b on b.conv_id = k.base),
m as (select conv_id, way, unnest(range(0, len(way) + 1)) as depth from r),
n as (
  select way[1:depth] as node, depth, min(conv_id) as conv_id, count(*) as n_convs,
         sha256(coalesce(string_agg(case when len(way) = depth then cast(conv_id as varchar) end, ',' order by conv_id), '')) as ends_sha256
  from m group by all),
p as (
  select n.*, u.conv_id as parent_conv_id, (n.n_convs - 1) * coalesce(strlen(n.node[n.depth].x), 0) as own,
         (select count(*) from n v where v.depth = n.depth + 1 and v.node[1:n.depth] = n.node) as n_children
  from n left join n u on u.depth = n.depth - 1 and u.node = n.node[1:n.depth - 1]),
a as (select *, unnest(range(0, depth + 1)) as up from p),
q as (select node[1:up] as node, up as depth, sum(own) as saved_tokens, count(*) filter (n_children = 0) as n_leaves from a group by all)
select p.conv_id, p.depth, p.parent_conv_id, p.n_convs, p.n_children, q.n_leaves, cast(q.saved_tokens as bigint) as saved_tokens, p.ends_sha256
from p join q on q.depth = p.depth and q.node = p.node
"""
