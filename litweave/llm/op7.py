"""Query op7_minhash: near-duplicate components of all documents, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .minhash import near_duplicates


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


#: All pairs that share a shingle, then reachability, with no sketch.
SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents),
s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then []::varchar[]
    when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as g
  from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (
  select x.doc_id as a, y.doc_id as b, count(*) as i from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by all),
l as (
  select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * i >= 75 * (na.n + nb.n - i)),
e as (select a as u, b as v from l union all select b, a from l),
r(u, v) as (select u, u from e union select r.u, e.v from r join e on e.u = r.v),
c as (select u, min(v) as c from r group by u)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.c, w.doc_id) as component_id, coalesce(c.c, w.doc_id) = w.doc_id as kept
from w left join n using (doc_id) left join c on c.u = w.doc_id
"""
