"""Queries over whole inputs, against brute force on small tables."""

import datetime
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from litweave.plans.queries import QUERIES


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Orders by up to six of forty suppliers: most of the pairs weigh less than 1."""
    d, r = tmp_path_factory.mktemp("small"), random.Random(3)
    authors = [sorted(r.sample(range(40), r.randrange(2, 7))) for _ in range(90)]
    orders = [(i, datetime.date(2000 + i % 9, 1, 1), "F", "1-URGENT", 1000.0 + i) for i in range(len(authors))]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate date, o_orderstatus string, o_orderpriority string, o_totalprice double").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(i, a % 5, a) for i, x in enumerate(authors) for a in x], "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(i, f"word{i} thing", "TYPE", i + 1) for i in range(5)], "p_partkey long, p_name string, p_type string, p_size int").write.parquet(f"{d}/part.parquet")
    w = np.zeros((40, 40))
    for x in authors:
        for a, b in itertools.combinations(x, 2):
            w[a, b] += 1 / (len(x) - 1)
    w = np.round(w + w.T, 6)
    assert (w.sum(axis=1) > 0).all() and (w[w > 0] < 1).mean() > 0.5
    return str(d), w


def brokers(w):
    on, group = w > 0, np.arange(len(w)) % 5
    p, m = w / w.sum(axis=1, keepdims=True), w / w.max(axis=1, keepdims=True)
    constraint = (((p + p @ p) ** 2) * on).sum(axis=1)
    size = on.sum(axis=1) - ((p @ m.T) * on).sum(axis=1)
    inside = np.stack([w[:, group == g].sum(axis=1) for g in range(5)])
    part = 1 - (inside**2).sum(axis=0) / inside.sum(axis=0) ** 2
    return constraint, size, part


def test_graph_measures_of_all_edges(spark, small):
    d, w = small
    on = (w > 0).astype(float)
    constraint, size, part = brokers(w)
    g = QUERIES["g02_network_summary"](spark, d).first()
    deg, tri = on.sum(axis=1), np.diag(on @ on @ on) / 2
    assert (g["nodes"], g["edges"], g["triangles"]) == (40, on.sum() / 2, tri.sum() / 3)
    assert g["density"] == pytest.approx(deg.sum() / 40 / 39) and g["average_clustering"] == pytest.approx(np.mean(2 * tri / np.maximum(1, deg * (deg - 1))), abs=1e-7)
    got = {x["node"]: x for x in QUERIES["g01_constraint"](spark, d).collect()}
    assert [got[i]["constraint"] for i in range(40)] == pytest.approx(constraint, abs=2e-6) and [got[i]["effective_size"] for i in range(40)] == pytest.approx(size, abs=2e-6)
    got = {x["node"]: x for x in QUERIES["g01_participation"](spark, d).collect()}
    assert [got[i]["strength"] for i in range(40)] == pytest.approx(w.sum(axis=1), abs=2e-6) and [got[i]["participation"] for i in range(40)] == pytest.approx(part, abs=2e-6)


def test_structural_holes_have_no_edge_of_any_weight(spark, small):
    d, w = small
    _, size, part = brokers(w)
    top = sorted(range(40), key=lambda i: (-round(size[i], 6), i))[:30]
    want = {(a, b): (size[a] + size[b]) * (part[a] + part[b] + 0.1) for a, b in itertools.combinations(sorted(top), 2) if a % 5 != b % 5 and not w[a, b]}
    from litweave.operators import networks
    from litweave.plans.catalog import author_edges

    e = author_edges(spark, d)
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("community", F.col("node") % 5)
    holes = networks.structural_holes(networks.participation(e, nodes).join(networks.constraint(e), "node"), e)
    got = {(x["node_a"], x["node_b"]): x["score"] for x in holes.collect()}
    assert got.keys() == want.keys() and [got[k] for k in want] == pytest.approx(list(want.values()), abs=1e-4)


def test_deduplicate_keeps_the_longer_abstract(spark, tmp_path):
    head = "A study of many networks and of their authors over twenty years, told at length for all who read it to the end of it. "[:120].ljust(120, "x")
    rows = [(1, head + "a" * 600, "en", "s", 720), (2, head + "a" * 600 + "b" * 900, "en", "s", 1620), (3, "Something else " * 60, "en", "s", 900)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["record_id"]: (x["merged"], x["abstract"]) for x in QUERIES["j02_deduplicate"](spark, str(tmp_path)).collect()}
    assert got == {"1": (["2"], rows[1][1]), "3": ([], rows[2][1].strip())}  # canonical abstracts have no white space at their ends


def test_flow_null_of_a_hundred_runs(spark, sf):
    from litweave.operators import topics
    from litweave.plans.adapters import orders_as_works, self_citations

    want = topics.flow_null(self_citations(spark, sf), orders_as_works(spark, sf), runs=100)
    got = QUERIES["g05_flow_null"](spark, sf)
    columns = ["source_topic", "target_topic", "null_mean", "null_sd", "null_z"]
    rows = [sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in f.select(columns).fillna(-9.0).collect()) for f in (got, want)]
    assert rows[0] == rows[1] and rows[0]


def test_backbone_of_more_than_25_nodes(spark, small):
    d, w = small
    got = {(x["a"], x["b"]): x["weight"] for x in QUERIES["t03_graph_backbone"](spark, d).collect()}
    assert got == {(a, b): w[a, b] for a, b in itertools.combinations(range(40), 2) if w[a, b]} and len(got) > 300
