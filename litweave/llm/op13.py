"""Query op13_divergence: how far apart all sources are in their words, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .divergence import LEAST_DOCS, RANKS, UNIT, divergence


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


#: Every term of every pair, one by one.
SQL = rf"""
with d as (
  select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ws
  from documents),
w as (select i, lang, source, unnest(ws) as term from d),
k as (select lang, term from w group by all having count(distinct i) >= {LEAST_DOCS}),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from w semi join k using (lang, term) group by all),
x as (select lang, source, term, coalesce(n, 0) as n from g join k using (lang) left join c using (lang, source, term)),
t as (select *, sum(n) over (partition by lang, source) + count(*) over (partition by lang, source) as m,
             sum(n) over (partition by lang, term) as lang_n from x),
s as (select *, 1 + ({UNIT}::hugeint * (n + 1)) // m as p,
             1 + ({UNIT}::hugeint * (lang_n + 1)) // (sum(n) over (partition by lang) + count(*) over (partition by lang, source)) as lang_p from t),
f as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value from s a join s b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0) as value
          from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
words as (select lang, source, 'term' as part, term as item, ((p - lang_p) * (p - lang_p)) // lang_p as value from s where n > 0 and p > lang_p),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (from pairs union all from words))
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from r where part = 'pair' or rank <= {RANKS}
"""
