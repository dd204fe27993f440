"""Every query of the library against the same rows from SQL."""

import math

import duckdb
import pytest

from litweave.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(float(v), 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    r = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in r.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted((tuple(plain(v) for v in row) for row in r.fetchall()), key=repr)
    assert want
    assert sorted((tuple(plain(row[c]) for c in columns) for row in got.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows_without_sql(spark, sf, name):
    """These are held to plain versions in other tests; here each must have rows, and the same in a second run."""
    f = QUERIES[name](spark, sf)
    rows = sorted(map(repr, f.collect()))
    assert rows and len(set(f.columns)) == len(f.columns)
    assert name not in RANGES or len(rows) == RANGES[name]
    if name not in SLOW:
        assert sorted(map(repr, QUERIES[name](spark, sf).collect())) == rows


#: Fits that take their time; their tests are in test_models.py.
SLOW = ("m04_topic_diagnostics", "t05_topics", "m10_cluster_diagnostics", "g04_directed_betweenness")


#: Numbers of topics from 4 to 8, of groups from 2 to 10.
RANGES = {"m04_topic_diagnostics": 5, "m10_cluster_diagnostics": 9}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_results_do_not_depend_on_partitions(spark, sf):
    seen = set()
    for n in (1, 3, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(tuple(sorted(map(tuple, QUERIES["a04_keyword_cooccurrence_fractional"](spark, sf).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(seen) == 1


def test_library_queries_without_the_corpus_operators(monkeypatch):
    import sys

    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "litweave.llm", None)  # as if it could not be imported
    assert e.queries().keys() == QUERIES.keys() and e.oracle_sql().keys() == ORACLE_SQL.keys()
