"""Query op4_mixing: the mix of all documents, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .mixing import BLOCK_WORDS, SEED, SHARD_DOCS, SHARDS_AT_ONCE, mix


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _h(*parts: str) -> str:
    text = "concat_ws('|', " + ", ".join(f"coalesce(cast({p} as varchar), chr(0))" for p in parts) + ")"
    return f"cast(('0x' || substr(md5({text}), 1, 13)) as bigint)"


#: Ranks every quotient of every seat, where the operator ranks only those near a row's exact share.
SQL = f"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size,
         {_h(f"'{SEED}'", "doc_id")} as h
  from documents),
n as (select source, count(*) as docs, cast(sum(size) as bigint) as source_size, cast(ceil(count(*) / {SHARD_DOCS}.0) as bigint) as shards from d group by source),
w as (select *, cast(case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as double) as weight,
             cast(2.0 * source_size as double) as cap, cast(1.5 * sum(source_size) over () as double) as budget from n),
l as (select *, cap / weight as ratio, row_number() over (order by cap / weight, source nulls last) as r,
             (budget - (sum(cap) over (order by cap / weight, source nulls last rows unbounded preceding) - cap))
             / (sum(weight) over () - sum(weight) over (order by cap / weight, source nulls last rows unbounded preceding) + weight) as lev from w),
t as (select source, source_size, shards, least(cap, weight * coalesce((select arg_min(lev, r) from l where lev <= ratio), 'inf'::double)) as target from l),
b as (select *, cast(round((select sum(target) from t) / {BLOCK_WORDS}) as bigint) as blocks from t),
bq as (select source, i, row_number() over (order by target / (2 * i + 1) desc, source nulls first, i) as rk, blocks
       from (select *, unnest(range(0, 2 + cast(ceil(2 * target / {BLOCK_WORDS}) as bigint))) as i from b) where target > 0),
sb as (select b.source, b.source_size, b.target, b.shards, count(bq.i) as source_blocks from b left join bq on bq.source is not distinct from b.source and bq.rk <= bq.blocks group by all),
ds as (select d.*, sb.source_size, sb.target, sb.source_blocks, d.h % sb.shards as shard from d join sb on d.source is not distinct from sb.source),
s0 as (select source, shard, shard // {SHARDS_AT_ONCE} as run, cast(sum(size) as bigint) as shard_size, any_value(source_blocks) as source_blocks from ds group by source, shard),
u as (select source, run, sum(shard_size) as run_size, any_value(source_blocks) as source_blocks from s0 group by source, run),
uq as (select source, run, source_blocks, row_number() over (partition by source order by run_size / (2 * i + 1) desc, run, i) as rk
       from (select *, unnest(range(0, 2 + source_blocks)) as i from u) where run_size > 0),
ub as (select u.source, u.run, count(uq.rk) as run_blocks from u left join uq on uq.source is not distinct from u.source and uq.run = u.run and uq.rk <= uq.source_blocks group by all),
s as (select s0.source, s0.shard, s0.run, s0.shard_size, ub.run_blocks from s0 join ub on ub.source is not distinct from s0.source and ub.run = s0.run),
sq as (select source, shard, run_blocks, row_number() over (partition by source, run order by shard_size / (2 * i + 1) desc, shard, i) as rk
       from (select *, unnest(range(0, 2 + run_blocks)) as i from s) where shard_size > 0),
q as (select s.source, s.shard, s.shard_size, cast(ceil(s.shard_size / {BLOCK_WORDS}.0) as bigint) as have, count(sq.rk) as quota0
      from s left join sq on sq.source is not distinct from s.source and sq.shard = s.shard and sq.rk <= sq.run_blocks group by all),
q2 as (select *, least(quota0, 2 * have) as quota, {_h(f"'{SEED}'", "'start'", "source", "shard")} % greatest(have, 1) as st from q),
x as (select ds.*, q2.shard_size, q2.have, q2.quota, q2.st,
             sum(size) over (partition by ds.source, ds.shard order by ds.h, ds.doc_id, ds.size rows unbounded preceding) as t
      from ds join q2 on ds.source is not distinct from q2.source and ds.shard = q2.shard),
y as (select *, t - size as f, case when have > 0 then quota // have else 0 end as turns, case when have > 0 then quota % have else 0 end as rest from x)
select doc_id, size, source_size, target,
       cast(turns * size + greatest(0, least(t, least((st + rest) * {BLOCK_WORDS}, shard_size)) - greatest(f, st * {BLOCK_WORDS}))
            + greatest(0, least(t, greatest(0, st + rest - have) * {BLOCK_WORDS}) - f) as bigint) as taken
from y
"""
