"""Topic models, clusters, graph measures and bursts against plain Python."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from litweave.operators import graphs, modeling, networks, temporal, textmining, topics, vertices
from tests.plain_bursts import all_paths


def documents(n=60, groups=3, seed=1):
    """Documents of a few words of one of several groups, and some words of all."""
    r = random.Random(seed)
    return [(i, [f"g{i % groups}w{r.randrange(6)}" for _ in range(12)] + [f"all{r.randrange(4)}" for _ in range(3)]) for i in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(f"d{i:03d}", t, " ".join(t)) for i, t in documents()] + [("empty", [], ""), ("null", None, None)]
    return spark.createDataFrame(rows, "record_id string, tokens array<string>, words string").repartition(3)


def tfidf(texts, low, high, min_df, max_df, most, sub=True):
    grams = {i: Counter(" ".join(t[k : k + n]) for n in range(low, high + 1) for k in range(len(t) - n + 1)) for i, t in texts.items()}
    df, cf = Counter(x for g in grams.values() for x in g), Counter()
    for g in grams.values():
        cf.update(g)
    n = len(texts)
    chosen = sorted((x for x in df if min_df <= df[x] <= max_df * n), key=lambda x: (-cf[x], x))[:most]
    idf = {x: math.log((1 + n) / (1 + df[x])) + 1 for x in chosen}
    out = {}
    for i, g in grams.items():
        w = {x: (1 + math.log(c) if sub else c) * idf[x] for x, c in g.items() if x in idf}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out |= {(i, x): v / norm for x, v in w.items()}
    return out


@pytest.mark.parametrize("kw", [{}, {"most_features": 25}, {"low": 2, "high": 4, "max_df": 1.0, "sublinear": False, "most_features": 50}, {"high": 1, "most_features": 5}])
def test_tfidf(spark, docs, kw):
    own = {"low": 1, "high": 3, "most_features": 4000, "max_df": 0.97, "sublinear": True} | kw
    texts = {r["record_id"]: list(r["tokens"] or []) for r in docs.collect()}
    want = tfidf(texts, own["low"], own["high"], 2, own["max_df"], own["most_features"], own["sublinear"])
    got = {(r["record_id"], r["term"]): r["weight"] for r in textmining.tfidf(docs, "tokens", digits=9, **kw).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_factors_of_planted_topics(spark, docs):
    m = modeling.topic_model(docs, "tokens", F.col("words"), low=2, high=4, bootstraps=2, passes=40)
    d = {r["k"]: r for r in m.diagnostics.collect()}
    assert m.status == "ok" and m.selected["k"] == 3 and set(d) == {2, 3, 4}
    assert d[3]["stability"] == 1 and d[3]["preprocessing_stability"] > 0.8 and d[3]["bootstrap_stability"] > 0.8 and d[3]["min_topic_size"] == 20 and d[3]["converged"]
    assert d[2]["reconstruction_error"] > d[3]["reconstruction_error"] > d[4]["reconstruction_error"]
    by = defaultdict(set)
    for r in m.assignments.collect():
        by[r["topic_id"]].add(int(r["record_id"][1:]) % 3)
        assert 0 <= r["topic_entropy"] <= 1 + 1e-9 and r["mixed_topic"] == (r["topic_entropy"] >= 0.65)
    assert sorted(map(tuple, by.values())) == [(0,), (1,), (2,)]
    t = {r["topic_id"]: r for r in m.topics.collect()}
    for k, group in by.items():
        assert all(w.startswith(f"g{next(iter(group))}") for w in t[k]["top_terms"].split("; ")[:4]) and t[k]["documents"] == 20 and len(t[k]["representative_ids"].split("; ")) == 10
    gate = modeling.access(m.selected, 20, 1.0)
    assert gate == {"claim_allowed": True, "structure_allowed": True, "level": "claim"} and modeling.access(m.selected, 2, 1.0, "auto")["level"] == "claim"
    assert modeling.access(m.selected | {"strong_claims": False}, 20, 0.5)["level"] == "unavailable" and modeling.access(None, 0, 0)["level"] == "unavailable" and modeling.access(m.selected, 20, 1.0, "off")["level"] == "unavailable"
    assert modeling.topic_model(docs.limit(0), "tokens", F.col("words")).status == "insufficient-corpus"


def test_factors_step_like_plain_numpy(spark, docs):
    """One pass over the table is one round of alternating least squares by coordinates on the whole matrix."""
    matrix = modeling.Matrix.of(docs, "tokens", high=1)
    rows = {r["record_id"]: r for r in matrix.rows.collect()}
    x = np.zeros((len(rows), len(matrix.terms)))
    for i, k in enumerate(sorted(rows)):
        x[i, rows[k]["at"]] = rows[k]["weight"]
    h = np.random.default_rng(3).random((3, x.shape[1]))
    fit = modeling.Factors(h.copy())
    modeling.factorise(matrix, [fit], passes=1)
    (w,) = modeling.weights_of(x, [h])
    assert fit.loss == pytest.approx(((x - w @ h) ** 2).sum())
    plain = h.copy()
    for _ in range(modeling.INNER):
        for r in range(3):
            plain[r] = np.maximum(plain[r] + ((w.T @ x)[r] - (w.T @ w)[r] @ plain) / (w.T @ w)[r, r], 0)
    assert np.allclose(fit.h, plain)
    v, sigma = modeling.singular(matrix, 3, passes=12)
    u, s, vt = np.linalg.svd(x)
    assert sigma == pytest.approx(s[:3], rel=1e-4) and np.allclose(np.abs(np.sum(v * vt[:3], axis=1)), 1, atol=1e-3)


def test_small_kernels():
    rng = np.random.default_rng(1)
    for _ in range(20):
        s = rng.random((4, 4))
        best = max(itertools.permutations(range(4)), key=lambda p: sum(s[i, p[i]] for i in range(4)))
        assert modeling.best_matching(s) == list(best)
    a, b = rng.integers(0, 3, 50), rng.integers(0, 4, 50)
    pairs = list(itertools.combinations(range(50), 2))
    both, x, y = sum(a[i] == a[j] and b[i] == b[j] for i, j in pairs), sum(a[i] == a[j] for i, j in pairs), sum(b[i] == b[j] for i, j in pairs)
    expected = x * y / len(pairs)
    assert modeling.rand_index(np.bincount(a * 4 + b, minlength=12).reshape(3, 4)) == pytest.approx((both - expected) / ((x + y) / 2 - expected))
    z = rng.normal(size=(30, 5))
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    own = rng.integers(0, 3, 30)
    d = 1 - z @ z.T
    want = []
    for i in range(30):
        inside = [d[i, j] for j in range(30) if j != i and own[j] == own[i]]
        outside = min(np.mean([d[i, j] for j in range(30) if own[j] == c]) for c in range(3) if c != own[i])
        want.append((outside - np.mean(inside)) / max(outside, np.mean(inside)))
    sums = np.stack([z[own == c].sum(axis=0) for c in range(3)])
    assert modeling.silhouette(z, own, sums, np.bincount(own)) == pytest.approx(want)
    n = modeling.draws([f"r{i}" for i in range(4000)], 0)
    assert n.mean() == pytest.approx(0.8, abs=0.06) and (modeling.draws(["r1", "r2"], 3) == modeling.draws(["r1", "r2"], 3)).all()


def test_clusters(spark, docs):
    c = modeling.clusters(docs, "tokens", high=4, restarts=3)
    assert c.status == "ok" and c.selected["k"] == 3 and c.selected["stability"] == 1 and c.selected["min_cluster_size"] == 20
    assert {tuple(sorted({int(r["record_id"][1:]) % 3 for r in rows})) for _, rows in itertools.groupby(sorted(c.assignments.collect(), key=lambda r: r["cluster_id"]), key=lambda r: r["cluster_id"])} == {(0,), (1,), (2,)}
    assert modeling.incremental(c.selected, 0.9)["status"] == "no-incremental-structure" and modeling.incremental(c.selected, 0.5)["writing_allowed"] and modeling.incremental(None, 0)["status"] == "unavailable"


def test_character_grams(spark):
    got = spark.createDataFrame([("Ab abcd",)], "t string").select(modeling.character_grams(F.col("t")).alias("g")).first()["g"]
    want = [p[i : i + n] for p in (" ab ", " abcd ") for n in (3, 4, 5) for i in range(len(p) - n + 1)]
    assert sorted(got) == sorted(want)


def test_directed_betweenness(spark):
    r = random.Random(4)
    edges = sorted({(r.randrange(14), r.randrange(14)) for _ in range(40)} - {(i, i) for i in range(14)})
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    nodes = sorted({x for e in edges for x in e})
    want = dict.fromkeys(nodes, 0.0)

    def paths(s, t):
        """All shortest paths."""
        front, seen = [[s]], {s}
        while front:
            hits = [p for p in front if p[-1] == t]
            if hits:
                return hits
            new = [[*p, u] for p in front for u in out[p[-1]] if u not in seen]
            seen |= {p[-1] for p in new}
            front = new
        return []

    for s, t in itertools.permutations(nodes, 2):
        found = paths(s, t)
        for p in found:
            for v in p[1:-1]:
                want[v] += 1 / len(found)
    n = len(nodes)
    got = {x["record_id"]: x["betweenness"] for x in graphs.directed_betweenness(spark.createDataFrame(edges, "source_id long, target_id long")).collect()}
    assert got == {k: pytest.approx(v / ((n - 1) * (n - 2)), abs=1e-6) for k, v in want.items()}


def test_kernels_and_summaries(spark):
    clique = lambda names: list(itertools.combinations(names, 2))
    edges = clique("abcd") + clique("efgh") + [("d", "m"), ("m", "e")] + clique("xyz")
    df = spark.createDataFrame([("n", a, b, 1.0) for a, b in edges], "network string, a string, b string, weight double")
    measured = vertices.hold(vertices.measures(df))
    nodes = {r["node"]: r for r in measured.collect()}
    assert nodes["m"]["betweenness"] == max(r["betweenness"] for r in nodes.values()) and nodes["a"]["k_core"] == 3 and nodes["x"]["k_core"] == 2
    assert nodes["m"]["effective_size"] == 2 and nodes["m"]["constraint"] == pytest.approx(0.5) and nodes["a"]["efficiency"] == pytest.approx(1 / 3, abs=1e-6)
    assert nodes["a"]["core_periphery"] == "core" and nodes["a"]["participation"] == 0 and all(0 <= r["participation"] <= 1 for r in nodes.values())
    s = vertices.summaries(df).first()
    assert (s["nodes"], s["edges"], s["components"]) == (12, 17, 2) and s["density"] == pytest.approx(34 / 132) and 0.3 < s["modularity"] < 1
    assert [r["node"] for r in graphs.leading_nodes(measured, 1).collect()] == ["m"]


def test_unlinked_brokers(spark):
    cols = "network string, node string, community long, effective_size double, participation double, betweenness double, brokerage_role string"
    rows = [("n", "alpha", 1, 3.0, 0.6, 0.5, "connector"), ("n", "beta", 2, 2.0, 0.5, 0.4, "broker"), ("n", "Alpha-beta", 3, 2.0, 0.5, 0.3, "broker"), ("n", "gamma", 2, 2.0, 0.5, 0.2, "hub"), ("n", "delta", 2, 1.0, 0.4, 0.1, "broker")]
    edges = spark.createDataFrame([("n", "delta", "alpha", 1.0)], "network string, a string, b string, weight double")
    got = {(r["node_a"], r["node_b"]): r["opportunity_score"] for r in graphs.unlinked_brokers(spark.createDataFrame(rows, cols), edges).collect()}
    assert got == {("alpha", "beta"): pytest.approx(5 * 1.2), ("Alpha-beta", "delta"): pytest.approx(3 * 1.0)}


def test_coupling_by_blocks(spark):
    r = random.Random(5)
    refs = {i: sorted(r.sample(range(12), r.randrange(0, 6)) + ([99] if i % 2 else [])) for i in range(60)}
    df = spark.createDataFrame(list(refs.items()), "record_id long, refs array<long>")
    want = {(a, b): len(set(refs[a]) & set(refs[b])) for a, b in itertools.combinations(refs, 2) if set(refs[a]) & set(refs[b])}
    for block in (2000, 7):
        assert {(x["record_a"], x["record_b"]): x["shared_references"] for x in networks.bibliographic_coupling(df, block=block).collect()} == want
    assert {(x["record_a"], x["record_b"]) for x in networks.bibliographic_coupling(df, least=3).collect()} == {k for k, v in want.items() if v >= 3}


def test_flow_null_is_a_permutation(spark):
    r = random.Random(6)
    rows = [(i, i % 3 + 1) for i in range(80)]
    edges = spark.createDataFrame([(r.randrange(80), r.randrange(80), 1) for _ in range(300)], "source_id long, target_id long, weight long")
    got = topics.flow_null(edges, spark.createDataFrame(rows, "record_id long, topic_id long"), runs=30).collect()
    # over all pairs of topics every permutation has all the weight
    total = {(x["source_topic"], x["target_topic"]): x["null_mean"] * x["citation_weight"] / x["fractional_flow"] for x in got}
    assert sum(total.values()) == pytest.approx(300, rel=1e-3) and all(x["null_sd"] > 0 for x in got) and len(got) == 9


def test_quadrants_that_are_far_from_the_medians_are_stable(spark):
    rows = [(1, 100.0, 5.0, "motor"), (2, 90.0, 0.1, "basic"), (3, 1.0, 4.0, "niche"), (4, 0.5, 0.05, "weakly-developed"), (5, 45.0, 1.0, "motor")]
    got = {r["topic_id"]: r["stability"] for r in topics.quadrant_stability(spark.createDataFrame(rows, "topic_id long, centrality double, density double, quadrant string")).collect()}
    assert all(got[i] >= 0.95 for i in (1, 2, 3, 4)) and 0.1 < got[5] < 0.5


def test_bursts_of_queries_are_those_of_plain_counts(spark, sf):
    from litweave.plans.catalog import with_trends
    from litweave.plans.queries import QUERIES

    w = [(r["record_id"], r["year"], set(r["keywords"] or []), r["topic_id"]) for r in with_trends(spark, sf).collect() if r["year"]]
    years = sorted({y for _, y, _, _ in w})
    totals = Counter(y for _, y, _, _ in w)
    by = defaultdict(Counter)
    for _, y, terms, _ in w:
        for t in terms:
            by[t][y] += 1
    want = {(t, a, b, p) for t, c in by.items() if sum(c.values()) >= 3 for a, b, _, p in all_paths([c[y] for y in years], [totals[y] for y in years], years)}
    got = QUERIES["w06_term_bursts"](spark, sf).collect()
    assert {(r["term"], r["start"], r["end"], r["peak"]) for r in got} == want and want
    for r in QUERIES["j19_burst_support"](spark, sf).collect():
        hits = sorted((i, t) for i, y, terms, t in w if r["term"] in terms and r["start"] <= y <= r["end"])
        assert r["supporting"] == len(hits) and r["supporting_documents"] == "; ".join(str(i) for i, _ in hits[:20]) and r["topic_ids"] == "; ".join(map(str, sorted({t for _, t in hits if t is not None})))


def test_citation_bursts_and_examples(spark):
    h = spark.createDataFrame([(1, {2000 + i: (30 if i in (4, 5) else 1) for i in range(9)}), (2, {2001: 5, 2002: 9, 2003: 1}), (3, None)], "record_id long, history map<int,int>")
    (b,) = temporal.citation_bursts(h).collect()
    assert (b["record_id"], b["start"], b["end"], b["peak"], b["uncertainty"]) == (1, 2004, 2005, 2004, "moderate")
    tok = spark.createDataFrame([(i, ["deep", "neural", "networks", f"x{i}"]) for i in range(4)], "record_id long, tokens array<string>")
    p = {r["record_id"]: r["phrases"] for r in temporal.phrases(tok).collect()}
    assert "deep neural networks" in p[0] and all(len(x) >= 5 for x in p[0])
    r = spark.createDataFrame([(1, "T", "First. Then Deep nets work! End"), (0, "U", "none")], "record_id long, title string, abstract string")
    t = spark.createDataFrame([(1, "deep nets"), (0, "absent")], "record_id long, term string")
    assert {x["term"]: x["representative_context"] for x in temporal.examples(r, t, F.col("abstract")).collect()} == {"deep nets": "Then Deep nets work!", "absent": "U"}


def test_pages_as_text(spark, sf):
    import html
    import re

    def plain(page):
        page = re.sub(r"(?is)<(script|style|svg|noscript)\b.*?</\1\s*>", " ", page)
        page = re.sub(r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|nav|header|footer|title)\b[^>]*>", "\n", page)
        text = html.unescape(re.sub(r"<[^>]+>", "", page)).replace("\xa0", " ")
        return "\n".join(x for x in (re.sub(r"[ \t\r\f]+", " ", t).strip() for t in text.split("\n")) if x)

    from litweave.plans.queries import QUERIES

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in QUERIES["s24_html_text"](spark, sf).collect()}
    assert got.keys() == pages.keys() and all(got[i] == plain(p) for i, p in pages.items())
    from litweave.functions.text import html_text

    odd = "<p>a &eacute;&#233;&#xE9; &amp;lt; &unknown; &#128512;</p>"
    assert spark.createDataFrame([(odd,)], "h string").select(html_text(F.col("h")).alias("t")).first()["t"] == plain(odd)


def test_pooled_queries_are_plain_random_effects(spark, sf):
    from litweave.plans.catalog import effects
    from litweave.plans.queries import QUERIES

    rows = effects(spark, sf).toPandas()
    for r in QUERIES["e17_meta_pooled"](spark, sf).collect():
        own = rows[rows["outcome"] == r["outcome"]]
        y, v = own["y"].to_numpy(float), own["s"].to_numpy(float) ** 2
        w = 1 / (v + r["tau2"])
        loss = lambda t, y=y, v=v: 0.5 * (np.log(v + t).sum() + math.log((1 / (v + t)).sum()) + (((y - ((y / (v + t)).sum() / (1 / (v + t)).sum())) ** 2) / (v + t)).sum())
        assert r["pooled"] == pytest.approx((w * y).sum() / w.sum()) and r["studies"] == len(own)
        assert all(loss(r["tau2"]) <= loss(r["tau2"] * f) + 1e-6 for f in (0.9, 0.99, 1.01, 1.1))
