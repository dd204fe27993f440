"""Measures of nodes as tables against plain loops, on several networks at once, with hubs, ties, isolates and any partitions."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from litweave.operators import vertices as V

from . import plain_graphs as plain

SCHEMA = "network string, a string, b string, weight double"


def drawn(network, n, m, seed, weights):
    r = random.Random(seed)
    pairs = set()
    while len(pairs) < m:
        a, b = r.sample(range(n), 2)
        if r.random() < 0.3:
            b = a // 10 * 10  # hubs, and groups of ten
        if a != b:
            pairs.add((min(a, b), max(a, b)))
    return [(network, f"n{a}", f"n{b}", float(r.choice(weights))) for a, b in sorted(pairs)]


@pytest.fixture(scope="module")
def rows():
    return drawn("x", 50, 110, 1, [1, 2, 0.5, 3]) + drawn("y", 20, 19, 2, [1]) + [("z", "a", "b", 1.0), ("z", "b", "a", 1.5), ("z", "a", "a", 9.0), ("z", "c", "d", 0.0), ("z", None, "d", 1.0)]


@pytest.fixture(scope="module")
def graph(spark, rows):
    e = V.hold(V.undirected(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    return e, V.Graph(e)


def matrices(rows):
    for network in ("x", "y"):
        names, w = plain.matrix(pd.DataFrame([r for r in rows if r[0] == network], columns=["network", "a", "b", "weight"]))
        yield network, names, w


def found(df, column):
    return {(r["network"], r["node"]): r[column] for r in df.collect()}


def same(got, rows, measure, **near):
    for network, names, w in matrices(rows):
        want = measure(w)
        assert np.allclose([got[network, n] for n in names], want, **near), network


def test_edges_are_one_each(graph):
    e, g = graph
    assert [tuple(r) for r in e.where("network = 'z'").collect()] == [("z", "a", "b", 2_500_000)]
    assert {r["node"] for r in g.nodes.where("network = 'z'").collect()} == {"a", "b"}


def test_pagerank_is_that_of_plain_iteration(spark, graph, rows):
    got = found(V.pagerank(graph[1]), "pagerank")
    same(got, rows, plain.pagerank, atol=1e-8, rtol=0)
    alone = spark.createDataFrame([("y", f"alone{i}") for i in range(3)], "network string, node string")
    got = found(V.pagerank(V.Graph(graph[0].where("network = 'y'"), isolated=alone)), "pagerank")
    w = [m for n, _, m in matrices(rows) if n == "y"][0]
    names = [names for n, names, _ in matrices(rows) if n == "y"][0]
    want = plain.pagerank(np.pad(w, (0, 3)))
    assert np.allclose([got["y", n] for n in [*names, "alone0", "alone1", "alone2"]], want, atol=1e-8, rtol=0)


def test_core_numbers_are_those_of_peeling(graph, rows):
    same(found(V.core_numbers(graph[1]), "k_core"), rows, plain.core_numbers)


def test_triangles_and_clustering(graph, rows):
    e, g = graph
    same(found(V.clustering(e, g), "clustering"), rows, plain.clustering)
    same(found(V.clustering(e, g, weighted=True), "clustering"), rows, lambda w: plain.clustering(w, True))
    few = sorted(map(str, V.triangles(e, block=2).collect()))
    assert few == sorted(map(str, V.triangles(e).collect())) and few


def test_betweenness_and_closeness_in_batches(graph, rows):
    e, g = graph
    same(found(V.betweenness(g, batch=50), "betweenness"), rows, plain.betweenness, atol=1e-9)
    same(found(V.closeness(g, batch=50), "closeness"), rows, plain.closeness, atol=1e-9)


def quality(w, member):
    return plain.modularity(w, np.array(member))


def test_no_single_move_improves_the_communities(spark, graph, rows, monkeypatch):
    e, g = graph
    place = V.hold(V.communities(e, g))
    got, q = found(place, "community"), found(V.modularity(e, g, place).withColumn("node", F.lit("")), "modularity")
    for network, names, w in matrices(rows):
        own = [got[network, n] for n in names]
        at = {c: i for i, c in enumerate(sorted(set(own)))}
        member = [at[c] for c in own]
        assert quality(w, member) == pytest.approx(q[network, ""], abs=1e-12) and all(c == min(n for n, d in zip(names, own, strict=True) if d == c) for c in own)
        assert q[network, ""] > 0.3
        for i in range(len(names)):
            for c in {member[j] for j in np.flatnonzero(w[i])} - {member[i]}:
                assert quality(w, [c if k == i else m for k, m in enumerate(member)]) <= q[network, ""] + 1e-12
    monkeypatch.setattr(V, "PART", 4)
    monkeypatch.setattr(V, "FEW", 3)
    for parts in (7,):
        e2 = V.undirected(spark.createDataFrame(rows[::-1], SCHEMA).repartition(parts))
        assert found(V.communities(e2, V.Graph(e2)), "community") == got


def test_random_graphs_have_their_edges_once(spark):
    sizes = [("a", 1, 2, 1), ("b", 2, 3, 3), ("c", 3, 40, 100), ("c", 4, 40, 100), ("d", 5, 9, 99), ("e", 6, 300, 9000)]
    df = spark.createDataFrame(sizes, "network string, seed int, nodes long, edges long").withColumn("network", F.concat("network", "seed"))
    e = V.random_edges(df).toPandas()
    for name, seed, n, m in sizes:
        own = e[e["network"] == f"{name}{seed}"]
        pairs = {(int(a), int(b)) for a, b in zip(own["a"], own["b"], strict=True)}
        assert len(pairs) == len(own) == min(m, n * (n - 1) // 2) and all(0 <= a < b < n for a, b in pairs)
    degree = np.bincount(e[e["network"] == "e6"][["a", "b"]].astype(int).to_numpy().ravel(), minlength=300)
    assert abs(degree.mean() - 60) < 1e-9 and 5 < degree.std() < 10  # about the binomial's 6.9


def test_sensitivity(spark, rows):
    got = {(r["network"], r["threshold"]): r for r in V.sensitivity(spark.createDataFrame(rows, SCHEMA), runs=4).collect()}
    for network, _, w in matrices(rows):
        for t in (1, 2, 3):
            on = (w >= t).astype(float)
            on = on[on.any(axis=1)][:, on.any(axis=1)]
            if not len(on):
                assert (network, t) not in got
                continue
            r = got[network, t]
            assert (r["nodes"], r["edges"], r["null_runs"]) == (len(on), on.sum() / 2, 4) and r["clustering"] == pytest.approx(plain.clustering(on).mean(), abs=1e-6)
            assert 0 <= r["null_mean"] <= 2.5 * on.sum() / len(on) / (len(on) - 1) + 0.02


def test_all_measures_and_summaries(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    m = V.measures(df).toPandas().set_index(["network", "node"])
    s = V.summaries(df).toPandas().set_index("network")
    for network, names, w in matrices(rows):
        own = m.loc[network].loc[names]
        constraint, size = plain.holes(w)
        assert np.allclose(own["constraint"], constraint, atol=1e-6) and np.allclose(own["effective_size"], size, atol=1e-6)
        strength, degree = w.sum(axis=1), (w > 0).sum(axis=1)
        assert np.allclose(own["efficiency"], size / degree, atol=1e-6) and (own["degree"] == degree).all()
        member = own["community"].to_numpy()
        for i in range(len(names)):
            share = np.array([w[i][member == c].sum() for c in set(member)]) / strength[i]
            peers = strength[member == member[i]]
            assert own["participation"].iloc[i] == pytest.approx(1 - (share**2).sum(), abs=1e-7)
            assert own["within_module_z"].iloc[i] == pytest.approx((strength[i] - peers.mean()) / peers.std() if peers.std() > 1e-12 else 0, abs=1e-6)
        core = (own["k_core"] >= own["k_core"].max()) | (own["pagerank"] >= np.quantile(own["pagerank"], 0.75) - 1e-9)
        assert (own["core_periphery"] == np.where(core, "core", "periphery")).mean() > 0.98
        role = np.select([(own["participation"] >= 0.55) & (own["betweenness"] > 0), (own["constraint"] <= 0.45) & (own["effective_size"] >= 2), own["core_periphery"] == "core"], ["connector", "broker", "hub"], "peripheral")
        assert (own["brokerage_role"] == role).all()
        at = {c: i for i, c in enumerate(sorted(set(member)))}
        assert tuple(s.loc[network][["nodes", "edges", "components"]]) == (len(names), int(degree.sum() // 2), plain.pieces(w))
        assert s.loc[network]["modularity"] == pytest.approx(quality(w, [at[c] for c in member]), abs=1e-8)
        assert s.loc[network]["average_clustering"] == pytest.approx(plain.clustering(w, True).mean(), abs=1e-8)
    assert set(s.index) == {"x", "y", "z"}


def test_no_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert V.measures(none).collect() == [] and V.summaries(none).collect() == [] and V.sensitivity(none).collect() == []
