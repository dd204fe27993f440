"""Operators that SQL does not express, on cases that can be worked out by hand."""

import math
import random

import numpy as np
import pytest

from litweave.functions import text as X
from litweave.operators import dedup, evidence, graphs, meta, temporal

from . import plain_graphs
from .plain_bursts import all_paths


def test_burst_of_one_stretch():
    years = list(range(2000, 2010))
    counts, totals = [1, 1, 1, 1, 20, 25, 1, 1, 1, 1], [100] * 10
    ((start, end, strength, peak),) = all_paths(counts, totals, years)
    assert (start, end, peak) == (2004, 2005, 2005) and strength > 0
    assert all_paths([1] * 10, totals, years) == []


def test_bursts_equal_the_cheapest_of_all_paths(spark):
    r, rows = random.Random(7), []
    for i in range(300):
        n = r.randrange(4, 10)
        totals = [r.choice([0, 5, 10, 40]) for _ in range(n)]
        counts = [min(t, r.choice([0, 0, 1, 2, 2, 9, 30])) for t in totals]
        rows.append((i, counts, totals, [2000 + 2 * y for y in range(n)]))
    rows += [(300, [0, 1, 0, 0], [5] * 4, [1, 2, 3, 4]), (301, [5] * 4, [5] * 4, [1, 2, 3, 4]), (302, [0] * 4, [0] * 4, [1, 2, 3, 4]), (303, [9, 9, 0, 0], [10, 10, 90, 90], [1, 2, 3, 4])]
    df = spark.createDataFrame(rows, "id int, counts array<long>, totals array<long>, years array<long>")
    got = sorted((x["id"], *x["b"]) for x in temporal.bursts(df).collect())
    want = sorted((i, *b) for i, c, t, y in rows for b in all_paths(c, t, y))
    assert len(want) > 50 and [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want, strict=True))
    assert "Python" not in temporal.bursts(df)._jdf.queryExecution().toString()


def test_bursts_of_terms(spark):
    rows = [(f"{y}-{i}", y, ["hot"] if i < (9 if y in (2004, 2005) else 1) else ["cold"]) for y in range(2000, 2010) for i in range(20)]
    got = temporal.term_bursts(spark.createDataFrame(rows, "record_id string, year int, keywords array<string>")).where("term = 'hot'").collect()
    assert [(r["start"], r["end"]) for r in got] == [(2004, 2005)]


def test_kernels_of_two_cliques():
    w = np.zeros((6, 6))
    for g in ((0, 1, 2), (3, 4, 5)):
        for a in g:
            for b in g:
                w[a, b] = a != b
    w[2, 3] = w[3, 2] = 1
    member = np.array([0, 0, 0, 1, 1, 1])
    assert plain_graphs.modularity(w, member) == pytest.approx(6 / 7 - 0.5)
    assert plain_graphs.betweenness(w)[2] == pytest.approx(6 / 10) and plain_graphs.betweenness(w)[0] == 0
    assert plain_graphs.pagerank(w).sum() == pytest.approx(1)
    assert plain_graphs.core_numbers(w).tolist() == [2] * 6
    assert plain_graphs.closeness(w)[2] == pytest.approx(5 / 7)


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(40, 41)], "a long, b long")
    got = {r["node"]: r["component"] for r in graphs.components(e).collect()}
    assert {got[i] for i in range(1, 21)} == {1} and got[41] == 40


def work(i, title, **k):
    own = dict.fromkeys(dedup.NAMES) | {"record_id": f"r{i}", "place": i, "title": title, "author": "A", "year": 2020, "abstract": "", "keywords": [str(i)], "references": [], "query_ids": [], "citation_counts": {"x": i}, "citation_counts_by_year": {}}
    return own | k


def test_fold_is_the_same_as_over_all(spark):
    rows = [
        work(0, "Deep learning for graphs and more", doi="d1"), work(1, "Deep learning for graphs and more."), work(2, "Another work altogether"), work(3, "Deep learning on graph and more", doi="d1"),
        work(4, "Another work altogether", year=2010), work(5, "", openalex="W1"), work(6, "x", openalex="https://index/W1"), work(7, "", doi="d1", wos="WOS:1"), work(8, "", doi="d1", wos="WOS:1"),
        work(9, "Some chapter", pmcid="P1"), work(10, "Its other name", pmcid="P1"),
    ]
    for n in (1, 5):
        got = sorted((r["record_id"], tuple(r["merged"]), tuple(r["methods"])) for r in dedup.deduplicate(spark.createDataFrame(rows, dedup.FIELDS).repartition(n)).collect())
        assert got == sorted((r["record_id"], tuple(r["merged"]), tuple(r["methods"])) for r in dedup.fold(rows))
    assert ("r5", ("r6",), ("openalex",)) in got and ("r7", ("r8",), ("doi-wos-confirmed",)) in got and ("r9", ("r10",), ("pmcid",)) in got


def test_verdicts_on_pairs():
    a = work(1, "Deep learning for graphs and more", doi="d")
    told = lambda **k: dedup.match(a, work(2, "Deep learning for graphs and more", doi="d") | k)[:2]
    assert told() == (True, "doi-title-confirmed") and told(doi="e") == (False, "different-doi") and told(year=2010) == (False, "doi-scope-conflict")
    assert told(title="") == (False, "doi-missing-title-review") and told(title="Deep learning of trees and less") == (False, "doi-ambiguous")
    assert told(author="Somebody Else") == (True, "doi-title-confirmed") or told(author="Zzz") == (False, "doi-ambiguous")
    assert told(doi=None, author="B") == (False, "title-year-author") and told(doi=None) == (True, "title-year-author") and told(doi=None, title=None) == (False, "missing-title")


def test_conflicts_and_scope_ids(spark):
    rows = [
        work(0, "Deep learning for graphs and more", doi="d", venue="V", abstract="short", citation_counts={"x": 1, "y": 2}, references=["a", "b"]),
        work(1, "Deep learning for graphs and more.", doi="d", venue="W", abstract="a longer one", language="en", citation_counts={"x": 5}, references=["b", "c"]),
        work(0, "An issue of a journal and nothing else", doi="d") | {"place": 2},
    ]
    got = {r["place"]: r for r in dedup.deduplicate(spark.createDataFrame(rows, dedup.FIELDS)).collect()}
    (step,) = got[0]["audit"]
    assert {(c["field"], c["kept"], c["alternate"]) for c in step["conflicts"]} == {("title", rows[0]["title"], rows[1]["title"]), ("venue", "V", "W"), ("abstract", "a longer one", "a longer one")}
    assert (got[0]["language"], got[0]["abstract"], got[0]["citation_counts"], got[0]["references"]) == ("en", "a longer one", {"x": 5, "y": 2}, ["a", "b", "c"])
    assert got[2]["record_id"] != "r0" and [x["action"] for x in got[2]["audit"]] == ["retained-separately"] and got[2]["audit"][0]["method"] == "doi-scope-conflict"


def test_canonical_records(spark):
    from litweave.functions import records

    df = spark.createDataFrame([(" A  title ", "https://doi.org/10.1/X.", "2001a", "x\n y", "a; b|a", ["Lee, A"]), ("B", None, "2001", None, None, None)], "title string, doi string, year string, abstract string, keywords string, authors array<string>")
    x, y = records.canonical(df, "file", "now").orderBy("title").collect()
    assert (x["title"], x["ids"]["doi"], x["year"], x["abstract"], x["keywords"], x["authors"][0]["name"], x["type"]) == ("A  title", "10.1/x", None, "x y", ["a", "b"], "Lee, A", "article")
    assert y["year"] == 2001 and y["authors"] == [] and y["provenance"][0]["source"] == "file" and len({x["record_id"], y["record_id"]}) == 2 and x["record_id"].startswith("R")
    assert records.canonical(df, "file", "now").columns == [f.name for f in records.RECORD.fields]
    scopes = [r["inclusion"]["evidence_scope"] for r in records.include_all(records.canonical(df, "f", "n")).orderBy("title").collect()]
    assert scopes == ["direct-or-adjacent-evidence", "metadata-only"]
    assert dedup.deduplicate(records.mergeable(records.canonical(df, "file", "now"))).count() == 2


def test_pooled_effects(spark):
    rows = [(f"e{i:02d}", "o", "hedges-g", f"s{i}", 0.3 + 0.1 * (i % 3), 0.1, None, None, None, float(i)) for i in range(12)]
    rows += [("x1", "p", "r", "a", 1.0, None, None, None, 50, None), ("x2", "p", "or", "b", 2.0, None, 1.0, 4.0, None, None)]
    e = spark.createDataFrame(rows, "effect_id string, outcome string, metric string, sample_id string, estimate double, standard_error double, ci_low double, ci_high double, n long, moderator double")
    got = {(r["outcome"], r["metric"]): r for r in meta.pooled(meta.valid_effects(e)).collect()}
    assert got["o", "hedges-g"]["pooled"] == pytest.approx(0.4) and got["o", "hedges-g"]["studies"] == 12 and got["o", "hedges-g"]["tau2"] >= 0
    assert ("p", "r") not in got and got["p", "or"]["status"] == "skipped-insufficient-data"


def plain_pool(y, s, x):
    """The least restricted loss by ever finer grids, then textbook formulas."""
    v, f = s**2, 1 / s**2

    def loss(t):
        w = 1 / (v + t)
        return np.log(v + t).sum() + math.log(w.sum()) + (w * (y - (w * y).sum() / w.sum()) ** 2).sum()

    low, high = 0.0, max(10 * y.var(), 0.01)
    for _ in range(12):
        grid = np.linspace(low, high, 101)
        at = int(np.argmin([loss(t) for t in grid]))
        low, high = grid[max(at - 1, 0)], grid[min(at + 1, 100)]
    tau = (low + high) / 2 if low > 0 else 0.0
    w = 1 / (v + tau)
    m, q = (w * y).sum() / w.sum(), (f * (y - (f * y).sum() / f.sum()) ** 2).sum()
    out = {"tau2": tau, "mean": m, "low": m - meta.Z / math.sqrt(w.sum()), "far": m + meta.Z * math.sqrt(tau + 1 / w.sum()), "q": q, "i2": max(0.0, (q - len(y) + 1) / q * 100)}
    if len(y) >= 10:
        a = np.column_stack([np.ones(len(y)), 1 / s])
        b, left = np.linalg.lstsq(a, y / s, rcond=None)[:2]
        error = math.sqrt(left[0] / (len(y) - 2) * np.linalg.inv(a.T @ a)[0, 0])
        out |= {"cut": b[0], "p": math.erfc(abs(b[0] / error) / math.sqrt(2))}
    has = np.isfinite(x)
    if has.sum() >= 10 and len(set(x[has])) >= 3:
        a = np.column_stack([np.ones(has.sum()), x[has]])
        inv = np.linalg.inv(a.T @ (a * f[has][:, None]))
        out |= {"slope": (inv @ a.T @ (f[has] * y[has]))[1], "error": math.sqrt(inv[1, 1])}
    return out


def test_pooling_of_all_groups_equals_each_on_its_own(spark):
    r, rows, want = np.random.default_rng(5), [], {}
    for g in range(14):
        n, metric = int(r.choice([3, 4, 9, 10, 40])), ("hedges-g", "r", "or", "rr")[g % 4]
        s = r.uniform(0.05, 0.4, n)
        y = r.normal(0.3 + (1000 if g == 12 else 0), s + (0, 0.3, 1.0)[g % 3])
        x = np.where(r.random(n) < 0.1, r.choice([np.nan, np.inf], n), r.integers(0, 2 if g == 5 else 6, n).astype(float))
        want[f"o{g}", metric] = plain_pool(y, s, x)
        rows += [(f"{g}-{i}", f"o{g}", metric, float(y[i]), float(s[i]), None if i == 1 else float(x[i])) for i in range(n)]
        x[1] = np.nan
        want[f"o{g}", metric] = plain_pool(y, s, x)
    rows.append(("z", "single", "r", 0.1, 0.1, None))
    e = spark.createDataFrame(rows, "effect_id string, outcome string, metric string, y double, s double, moderator double")
    got = {(x["outcome"], x["metric"]): x for x in meta.pooled(e).collect()}
    assert got.pop(("single", "r"))["status"] == "skipped-insufficient-data" and got.keys() == want.keys()
    for k, x in got.items():
        w, back = want[k], math.tanh if k[1] == "r" else math.exp if k[1] in ("or", "rr") else float
        assert x["tau2"] == pytest.approx(w["tau2"], abs=1e-6)
        assert [x["pooled"], x["ci_low"], x["prediction_high"]] == pytest.approx([back(w["mean"]), back(w["low"]), back(w["far"])], rel=1e-5)
        assert [x["q"], x["i2"]] == pytest.approx([w["q"], w["i2"]], rel=1e-6, abs=1e-6)
        assert [x[c] for c in ("egger_intercept", "egger_p", "slope", "slope_error")] == [None if w.get(c) is None else pytest.approx(w[c], rel=1e-5, abs=1e-9) for c in ("cut", "p", "slope", "error")]
    assert meta.pooled(e.where("outcome = 'single'")).count() == 1 and meta.pooled(e.limit(0)).count() == 0


def test_quality_and_text(spark):
    df = spark.createDataFrame([(1, "A survey", "n = 120 participants; a method", 2020, ["X"]), (2, "B", "N = 120 participants", 2020, ["x"]), (3, None, None, None, None)], "record_id int, title string, abstract string, year int, authors array<string>")
    got = {r["record_id"]: r for r in evidence.quality(df).collect()}
    assert got[1]["study_design"] == "survey" and got[1]["independent_sample_status"] == "possible-overlap-needs-review" == got[2]["independent_sample_status"]
    assert got[3]["evidence_level"] == "metadata"
    r = spark.createDataFrame([("研究深度学习 with the Graph networks。好！ok", "见 C0001–C0003, C0009")], "a string, b string").select(X.language_tokens(X.F.col("a")).alias("t"), X.sentences(X.F.col("a")).alias("s"), X.claim_ids(X.F.col("b")).alias("c")).first()
    assert r["t"][:2] == ["究深", "深度"] and "graph" in r["t"] and len(r["s"]) == 3 and r["c"] == ["C0001", "C0002", "C0003", "C0009"]


def test_stream_counts(spark, sf, tmp_path):
    from litweave.streaming import ingest

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf}/events.parquet").write.mode("overwrite").parquet(str(tmp_path / "in"))
    q = ingest.event_counts(ingest.read_events(spark, str(tmp_path / "in"), schema)).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(events) from counts").first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()
    write = ingest.merge_into(str(tmp_path / "out"), "id")
    for ids in ([1, 2, 2], [2, 3]):
        write(spark.createDataFrame([(i,) for i in ids], "id int"), 0)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_golden_section():
    assert meta.golden(lambda x: (x - 2) ** 2, 0, 5) == pytest.approx(2, abs=1e-6)
    assert meta.both_tails(1.96) == pytest.approx(0.05, abs=1e-3) and math.isclose(meta.back(0.5, "r"), math.tanh(0.5))


def test_adverse_claims_are_reconciled(spark):
    from litweave.operators.review import group_claims

    rows = [("a", None, "b", "+", "r1", "contradict", "p2"), ("a", "", "b", "+", "r2", "contradict", None), ("x", "p", "y", "", "r1", "support", ""), ("x", "p", "y", "", "r2", "support", "p1"), ("n", "p", "y", "", "r2", "not-significant", "p1")]
    rows += [("m", "p", "y", "-", f"r{i}", "support", "") for i in range(3)] + [("d", "p", "y", "", "r1", "support", None), ("d", "p", "y", "", "r1", "weak", None)]
    c = spark.createDataFrame(rows, "subject string, predicate string, object string, direction string, record_id string, status string, anchor string")
    got = {r["subject"]: (r["record_ids"], r["anchors"], r["studies"], r["reconcile"]) for r in group_claims(c).collect()}
    assert got == {"a": ("r1,r2", "p2", 2, True), "x": ("r1,r2", "p1", 2, False), "n": ("r2", "p1", 1, True), "m": ("r0,r1,r2", "", 3, True), "d": ("r1", "", 1, True)}
