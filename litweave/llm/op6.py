"""Query op6_embeddings: near-duplicate components of all embeddings, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .embeddings import near_duplicates


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: All pairs, then reachability.
SQL = """
with recursive v as (
  select vec_id, cast(embedding as double[]) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and list_sum(list_transform(embedding, lambda x: cast(x as double) * x)) > 0),
l as (
  select x.vec_id as a, y.vec_id as b from v x join v y on x.vec_id <> y.vec_id
  where list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e)) / sqrt(list_dot_product(y.e, y.e)) >= 0.95),
r(u, v) as (select vec_id, vec_id from v union select r.u, l.b from r join l on l.a = r.v),
c as (select u, min(v) as c from r group by u),
n as (select a, count(*) as n from l group by a)
select e.vec_id, coalesce(n.n, 0) as n_links, coalesce(c.c, e.vec_id) as component_id, coalesce(c.c, e.vec_id) = e.vec_id as kept
from embeddings e left join n on n.a = e.vec_id left join c on c.u = e.vec_id
"""
