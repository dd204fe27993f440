"""Rules over drafts, on sentences written by hand."""

from litweave.functions import manuscript as M
from litweave.operators import ledgers


def test_units_claims_and_references(spark):
    body = "# Head\n\n已有研究表明X有效；(Lee, 2019; Chen, 2020)支持；末尾。既有研究发现Y！研究显示Z（2020）。\n\n## References\n[1] Lee, A. A long reference title, 2019. 10.1234/AB.c\nshort\n"
    df = spark.createDataFrame([(1, body)], "id int, text string")
    units = df.select(M.atomic_units(M.F.lit("a；(b; c)；[d; e] f; ")).alias("u")).first()["u"]
    assert units == ["a；", "(b; c)；", "[d; e] f;"]
    found = [r["sentence"] for r in M.uncited_claims(df, "id", "text").collect()]
    assert found == ["既有研究发现Y！"]
    (ref,) = M.reference_lines(df, "id", "text").collect()
    assert (ref["doi"], ref["year"]) == ("10.1234/AB.c", 2019)


def test_gaps(spark):
    full = dict.fromkeys("title known_findings current_explanation failure_point failure_evidence knowledge_consequence repair_strategy research_questions design_requirements".split(), "x")
    rows = [full | {"gap_id": i, "failure_type": f, "comparable": c, "mechanism_audited": a, "boundary_assumption": b, "status": None} for i, f, c, a, b in (("1", "measurement", None, None, None), ("2", "contradiction", False, None, None), ("3", "contradiction", True, None, None), ("4", "mechanism-missing", None, True, None), ("5", "boundary-failure", None, None, ""), ("6", "distribution-only", None, None, None))]
    rows.append(rows[0] | {"gap_id": "7", "repair_strategy": ""})
    schema = ", ".join(f"{k} {'boolean' if k in ('comparable', 'mechanism_audited') else 'string'}" for k in rows[0])
    (told,) = ledgers.gap_report(spark.createDataFrame(rows, schema)).collect()
    kept = M.normalize_gaps(spark.createDataFrame(rows, schema)).collect()
    assert (told["gaps"], told["validated"], told["opportunities"]) == (len(rows), sum(r["status"] == "validated" and r["level"] in "AB" for r in kept), sum(r["level"] == "C" for r in kept)) and 0 < told["validated"] < len(rows) and told["state"] == "validated"
    assert ledgers.gap_report(spark.createDataFrame(rows[-1:], schema)).first()["state"] == "opportunity-only"
    got = {r["gap_id"]: (r["level"], r["status"], r["notes"]) for r in M.normalize_gaps(spark.createDataFrame(rows, schema)).collect()}
    assert got["1"] == ("B", "validated", "") and got["3"][:2] == got["4"][:2] == ("A", "validated")
    assert got["2"] == ("C", "opportunity", "not-comparable") and got["5"][2] == "no-boundary-assumption" and got["7"][2] == "incomplete-diagnosis" and got["6"][:2] == ("C", "opportunity")
    goals = spark.range(1).select(M.gap_goals(M.F.lit("contradiction"), M.F.array().cast("array<string>")).alias("g")).first()["g"]
    assert goals == ["explanation", "heterogeneity"]


def test_links(spark):
    texts = spark.createDataFrame([("a", "x", "see 10.1234/abc."), ("b", "y", "The very long title of one work, page 1"), ("c", "alongfilenamehere", ""), ("d", "z", "10.1234/abc and 10.1234/def")], "file string, stem string, text string")
    records = spark.createDataFrame([("r1", "10.1234/abc", "First"), ("r2", "10.1234/def", "The Very Long Title of One Work"), ("r3", None, "A long file name here and more")], "record_id string, doi string, title string")
    assert sorted(map(tuple, M.link_fulltexts(texts, records).collect())) == [("a", "r1"), ("b", "r2"), ("c", "r3")]
