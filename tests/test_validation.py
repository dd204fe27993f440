"""The report over corpus, ledger and drafts, on a case by hand."""

from pyspark.sql import functions as F

from litweave.functions.records import content_hash
from litweave.operators import validation

R = [f"R{i:014x}" for i in range(6)]


def test_report(spark):
    good = f"# T\n\n## One\nText {R[0]} and {R[1]} and {R[2]}.\n\n## Two\nMore, C0001 and {R[0]}.\n\n## 参考文献\n" + "\n".join(f"<!-- record:{r} --> x" for r in R[:3])
    bad = f"## Only\nTODO {R[5]} C0009: it has never been studied.\n\n## 参考文献\n<!-- record:{R[1]} --> a\n<!-- record:{R[1]} --> b"
    drafts = spark.createDataFrame([("good", good), ("bad", bad), ("none", None)], "name string, text string")
    ledger = spark.createDataFrame([("C0001", "abstract", "contradict", "low", "pending", [R[0], R[1]], ["a"]), ("C0002", "fulltext", "positive", "low", "unsupported", [R[0]], [])], "claim_id string, claim_type string, direction string, strength string, support_check string, record_ids array<string>, anchors array<string>")
    records = spark.createDataFrame([(r, "D" if i == 5 else "A") for i, r in enumerate(R)], "record_id string, tier string")
    eligible, registry = records.where("tier = 'A'"), records.limit(6)
    topics = spark.createDataFrame([(R[0], 1), (R[1], 1), (R[3], 2), (R[5], 2)], "record_id string, topic_id long")
    audits = drafts.select("name", F.when(F.col("name") == "bad", "old").otherwise(content_hash(F.coalesce("text", F.lit("")))).alias("source_sha256"))
    told = {tuple(r)[:3]: (r["available"], r["cited"], r["minimum"], r["status"]) for r in validation.coverage(drafts, "name", "text", ledger, eligible, topics).collect()}
    assert told["good", "overall", ""] == (5, 3, 3, "pass") and told["bad", "overall", ""] == (5, 0, 3, "fail") and told["none", "overall", ""][3] == "fail"
    assert told["good", "topic", "1"][:2] == (2, 2) and told["good", "topic", "2"][:2] == (1, 0) and told["good", "topic", "2"][3] == "fail"
    assert told["good", "section", "One"][1:] == (3, 2, "pass") and told["good", "section", "Two"][1:] == (2, 2, "pass") and told["bad", "section", "Only"][1:] == (1, 2, "fail")
    args = (drafts, "name", "text", ledger, records, eligible, topics, registry, audits)
    got = {(r["name"], r["rule"], r["severity"], r["id"]) for r in validation.draft_violations(*args).collect()}
    assert {g for g in got if g[0] == "good"} == {("good", "topic-under-quota", "error", "2")}
    errors = {("unknown-claim", "C0009"), ("tier-d-cited", R[5]), ("reference-repeated", R[1]), ("cited-not-listed", R[5]), ("listed-not-cited", R[1]), ("stale-audit", ""), ("coverage-under-minimum", ""), ("topic-under-quota", "1"), ("topic-under-quota", "2"), ("section-under-minimum", "Only")}
    assert {g[1::2] for g in got if g[0] == "bad" and g[2] == "error"} == errors
    assert {g[1] for g in got if g[0] == "bad" and g[2] == "warning"} == {"todo", "absolute-gap", "adverse-claims-unused"}
    assert {g[1] for g in got if g[0] == "none"} == {"no-references", "coverage-under-minimum", "topic-under-quota", "adverse-claims-unused"}
    corpus = spark.createDataFrame([(R[0], "d", "A title", False), (R[0], None, "Another", True)], "record_id string, doi string, title string, retracted boolean")
    report = validation.validation_report(corpus, (ledger, records, spark.createDataFrame([("C0001",)], "claim_id string"), {}), args)
    parts = {(r["part"], r["rule"], r["severity"]) for r in report.collect()}
    assert {("corpus", "record-id-not-unique", "error"), ("corpus", "retracted", "warning"), ("claims", "unsupported", "error"), ("claims", "fulltext-without-anchor", "error"), ("drafts", "stale-audit", "error"), ("drafts", "todo", "warning")} <= parts
    assert report.columns == ["part", "rule", "severity", "subject", "id"]
