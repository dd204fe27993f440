"""Audits of drafts, ledgers, plans, documents and sinks, on cases written by hand or counted out in plain Python."""

import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from litweave import sinks
from litweave.functions import plans
from litweave.operators import drafts, ledgers, meta, review
from litweave.sources import documents, parsers
from litweave.storage import numbered

R = [f"R{i:014x}" for i in range(12)]
DRAFT = f"""<!-- section:S1 -->
## 一、开端

[role:gap]研究表明价格影响需求 [cite:{R[1]}]。这导致购买！看法不一；没有证据 [cite:{R[2]}]。

[role:objective]（Lee, 2019）。本文 C0001–C0003 如此。

## 2. Unplanned part

多项研究显示一致 [cite:{R[1]}]。现有研究发现甲 [cite:{R[1]}]。证据显示乙 [cite:{R[1]}]。

## 参考文献

<!-- record:{R[1]} -->
Lee. (2019). Work.
<!-- record:{R[1]} -->
Lee. (2019). Work.
"""


@pytest.fixture(scope="module")
def draft(spark):
    return spark.createDataFrame([(1, DRAFT), (2, "## 参考文献\n"), (3, "")], "doc int, text string")


def reviews(spark, rows=()):
    return spark.createDataFrame(list(rows), "sentence_id string, atomic_claim_id string, support_status string, evidence_level string, claim_scope string, audit_notes string, design_fit string")


def ids(spark, values, name="record_id"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def ledger_of(spark, draft, rows=()):
    return drafts.sentence_ledger(draft, "doc", "text", "review", "final", reviews(spark, rows), ids(spark, R[:2]), ids(spark, [], "source_id"))


def test_sections(spark, draft):
    got = [(r["section_id"], r["title"], r["normal"]) for r in drafts.sections(draft, "doc", "text").where("doc = 1").orderBy("place").collect()]
    assert got == [("S1", "一、开端", "一开端"), ("", "2. Unplanned part", "unplannedpart"), ("", "参考文献", "参考文献")]
    approved = spark.createDataFrame([(1, "S1", "kaiduan"), (1, "", "unplannedparts")], "doc int, section_id string, normal string")
    left = drafts.unexpected_sections(drafts.sections(draft, "doc", "text"), approved, "doc").collect()
    assert [r["title"] for r in left] == ["参考文献"]


def test_sentences_and_their_errors(spark, draft):
    rows = {(r["paragraph"], r["place"]): r for r in ledger_of(spark, draft).collect()}
    assert [rows[k]["plain"] for k in sorted(rows)] == ["研究表明价格影响需求 。", "这导致购买！", "看法不一；没有证据 。", "（Lee, 2019）。", "本文 C0001–C0003 如此。", "多项研究显示一致 。", "现有研究发现甲 。", "证据显示乙 。"]
    first = min(rows)
    assert rows[first]["role"] == "gap" and rows[first]["errors"] == ["semantic-support-not-reviewed"] and rows[first]["record_ids"] == [R[1]]
    by = {r["plain"]: r["errors"] for r in rows.values()}
    assert by["这导致购买！"] == ["missing-exact-sentence-citation", "semantic-support-not-reviewed", "causal-wording-without-design-fit"]
    assert by["看法不一；没有证据 。"] == ["unknown-record-ids", "semantic-support-not-reviewed"] and by["（Lee, 2019）。"] == ["citation-only-fragment"]
    assert [(r["doc"], r["paragraph"]) for r in drafts.repeated_bindings(ledger_of(spark, draft), "doc").collect()] == [(1, rows_of(rows, "证据显示乙 。"))]
    queue = {r["plain"]: r["paragraph_record_ids"] for r in drafts.repair_queue(ledger_of(spark, draft), "doc").collect()}
    assert queue["这导致购买！"] == [R[1], R[2]] and "本文 C0001–C0003 如此。" not in queue


def rows_of(rows, plain):
    return next(p for (p, _), r in rows.items() if r["plain"] == plain)


def test_reviews_are_found_by_id_and_go_stale(spark, draft):
    first = ledger_of(spark, draft).where("place = 0 and role = 'gap'").first()["sentence_id"]
    done = [(first, None, "supported", "abstract", "narrow", "read", None)]
    s = ledger_of(spark, draft, done)
    assert s.where(F.col("sentence_id") == first).first()["errors"] == []
    changed = draft.withColumn("text", F.replace("text", F.lit("价格"), F.lit("收入")))
    assert ledger_of(spark, changed, done).where("support_status = 'supported'").count() == 0
    atomic = drafts.atomic_ledger(s, "doc", "review", "evidence-aware", "final", reviews(spark)).collect()
    by = {a["claim_text"]: a for a in atomic}
    assert by["研究表明价格影响需求 。"]["complete"] and by["研究表明价格影响需求 。"]["support_status"] == "supported"
    assert by["看法不一；"]["reasons"] == [] and not by["看法不一；"]["factual"] and by["没有证据 。"]["record_ids"] == [R[2]]
    problems = {(r["problem"], r["at"] == first) for r in drafts.traceability(s, drafts.atomic_ledger(s, "doc", "review", "evidence-aware", "final", reviews(spark)), "doc").collect()}
    assert ("sentence-not-bound", False) in problems and ("sentence-not-bound", True) not in problems and ("atomic-claim-not-bound", False) in problems


def test_atomic_claims_without_their_own_citation(spark):
    many = ",".join(R[:9])
    d = spark.createDataFrame([(1, f"研究发现甲和乙；同时证据显示丙与丁 [cite:{many}]。")], "doc int, text string")
    a = {r["claim_text"]: r["reasons"] for r in drafts.atomic_ledger(ledger_of(spark, d), "doc", "review", "v", "s", reviews(spark)).collect()}
    cluster = "heterogeneous-claims-share-one-large-citation-cluster"
    assert a == {"研究发现甲和乙；": ["atomic-claim-lacks-exact-citation", cluster], "同时证据显示丙与丁 。": [cluster]}


def test_citations_references_and_markers(spark, draft):
    claims = spark.createDataFrame([("C0002", [R[5]]), ("C0009", [R[6]])], "claim_id string, record_ids array<string>")
    body = draft.select("doc", drafts.body(F.col("text")).alias("text"))
    assert {r["record_id"] for r in drafts.cited_records(body, "doc", "text", claims).collect()} == {R[1], R[2], R[5]}
    assert draft.select(drafts.embedded_references(F.col("text")).alias("x")).first()["x"] == [R[1], R[1]]
    registry = spark.createDataFrame([(R[1], "Lee .  (2019).. Work ."), (R[5], "abe. (2001). https://x.org/..a")], "record_id string, apa string")
    r = drafts.reference_list(draft, "doc", "text", claims, registry).first()
    assert r["missing"] == [R[2]] and r["references"].index(R[5]) < r["references"].index(R[1]) and "(2019). Work" in r["references"]
    clean = draft.select(drafts.clean_markers(F.col("text")).alias("t")).first()["t"]
    assert not re.search(r"R[0-9a-f]{14}|\[role|<!--", clean) and "研究表明价格影响需求。" in clean.replace(" ", "")


def test_quality_of_prose(spark):
    text = f"""[role:gap]Scarce theoretical boundary of pricing.

[role:objective]We plan elephants.

甲研究 {R[0]} 如此。乙研究 {R[1]} 如此。丙研究 {R[2]} 如此。

甲理论、乙理论与丙模型并列。

本文的创新在于首次使用新方法。

研究发现正向 [cite:{R[0]},{R[1]}]。但是不显著 [cite:{R[0]},{R[1]}]。"""
    d = spark.createDataFrame([(1, text)], "doc int, text string")
    got = {(r["issue_code"], r["paragraph"]) for r in drafts.quality_issues(d, "doc", "text", "review").collect()}
    assert got == {("literature-list-without-synthesis", 3), ("multiple-theories-without-role-division", 4), ("distribution-or-method-novelty-framed-as-contribution", 5), ("opposing-evidence-shares-citation-cluster", 6)}
    intro = {(r["issue_code"], r["paragraph"]) for r in drafts.quality_issues(d, "doc", "text", "introduction").collect()}
    assert ("gap-objective-alignment-weak", 0) in intro and ("introduction-missing-knowledge-baseline", 0) in intro and ("gap-contribution-alignment-weak", 0) not in intro
    assert {r["role"] for r in drafts.missing_roles(d, "doc", "text").collect()} == set(drafts.INTRODUCTION_ROLES) - {"gap", "objective"}


def test_rewriting_and_delivery(spark):
    d = spark.createDataFrame([(1, "当前证据不足。可能如此。已经如此。没有支持。\n\n## 参考文献\n"), (2, "好；；坏 C0001。")], "doc int, text string")
    known = spark.createDataFrame([("可能如此。", "partial"), ("已经如此。", "partial"), ("没有支持。", "unsupported")], "plain string, support_status string")
    q = {r["sentence"]: (r["reason_codes"], r["required_action"]) for r in drafts.rewrite_queue(d.where("doc = 1"), "doc", "text", "review", known, review.BANNED).collect()}
    assert q == {"当前证据不足。": (["reader-facing-workflow-language"], "rewrite-reader-facing"), "已经如此。": (["partial-support-must-be-proposition"], "rewrite-as-testable-proposition"), "没有支持。": (["unsupported-claim-must-be-removed"], "remove")}
    assert {(r["doc"], r["defect"]) for r in drafts.delivery_defects(d, "doc", "text", True, review.PUNCTUATION).collect()} == {(2, "internal-ids"), (1, "paragraphs-out-of-range"), (2, "paragraphs-out-of-range")}


def test_candidate_evidence(spark):
    records = spark.createDataFrame([(R[0], "T", 2001, "a"), (R[1], "U", 2002, "")], "record_id string, title string, year int, abstract string")
    found = spark.createDataFrame([(R[0], "fulltext", "survey", "core", [("negative", "support"), (None, "mixed")], "completed")], "record_id string, evidence_level string, design string, relevance string, relations array<struct<direction:string,status:string>>, host_review_status string")
    got = {r["record_id"]: tuple(r)[1:] for r in drafts.candidate_evidence(ids(spark, R[:2]), records, found).collect()}
    assert got == {R[0]: ("T", 2001, "fulltext", "survey", "core", ["mixed", "negative"], "completed"), R[1]: ("U", 2002, "metadata", "unclear", "", [], "missing")}


def test_building_evidence(spark):
    cols = "record_id string, type string, title string, year int, abstract string, authors array<string>, doi string, retracted boolean"
    records = spark.createDataFrame([(R[0], "article", "Deep learning of graphs", 2001, "a survey", ["A"], "10.1/x", False), (R[1], "article", "Deep learning of graphs.", 2001, "", ["A"], "10.1/X", True)], cols)
    more = spark.createDataFrame([(R[1], "article", "again", 2001, "", ["A"], None, False), (R[2], "editorial", "An opinion", 2005, "", ["B"], "10.1/x", False)], cols)
    files = spark.createDataFrame([("f1", "Deep learning of graphs"), ("f2", "learning"), ("f3", "An opinion, with a longer tail to it"), ("f4", "op")], "path string, stem string")
    best = {r["record_id"]: r["path"] for r in ledgers.best_fulltexts(records.unionByName(more.where(F.col("record_id") == R[2])), files).collect()}
    assert best == {R[0]: "f1", R[1]: "f1", R[2]: "f3"}
    topics = spark.createDataFrame([(1, 2, "a; b", f"{R[0]}; {R[1]}")], "topic_id int, documents int, top_terms string, representative_ids string")
    signals = [("bursts", spark.createDataFrame([(2.0, "x", f"see {R[0]}"), (3.0, "y", "nothing"), (2.5, "z", R[1])], "strength double, value string, supporting string"))]
    kept = spark.createDataFrame([("C0001", "old", "abstract", "low", [R[0]]), ("C0007", "old", "abstract", "low", [R[0]])], "claim_id string, claim string, claim_type string, strength string, record_ids array<string>")
    built = ledgers.build_evidence(records, more, spark.createDataFrame([(R[0], "f1")], "record_id string, path string"), topics, True, signals, kept)
    assert [(r["claim_id"], r["evidence_scope"]) for r in built["ledger"].orderBy("claim_id").collect()] == [("C0001", "computed-or-host-synthesis"), ("C0007", "direct"), ("C2001", "computed-or-host-synthesis"), ("C2002", "computed-or-host-synthesis")]
    assert {r["record_id"]: (r["tier"], r["in_corpus"]) for r in built["records"].collect()} == {R[0]: ("A", True), R[1]: ("D", True), R[2]: ("D", False)}
    assert {r["record_id"]: r["evidence_level"] for r in built["cards"].collect()} == {R[0]: "fulltext", R[1]: "metadata", R[2]: "metadata"}
    assert {(r["rule"], r["id"]) for r in ledgers.corpus_violations(records).collect()} == {("repeated-doi", f"{R[0]} {R[1]}"), ("retracted", R[1])}
    assert {(r["b"], r["severity"]) for r in ledgers.repeated_dois(records.unionByName(more.where(F.col("record_id") == R[2]))).collect()} == {(R[1], "error"), (R[2], "warning")}
    assert ledgers.citation_quotas(10)["理论与机制"] == 3 and sum(ledgers.citation_quotas(100).values()) == 100


def test_eligible_records_wait_for_the_whole_screening(spark):
    r = spark.createDataFrame([(R[0], "A"), (R[1], "B"), (R[2], "D")], "record_id string, tier string")
    screened = lambda rows: spark.createDataFrame(rows, "record_id string, host_review_status string, relevance string")
    got = lambda s, p: sorted(x["record_id"] for x in ledgers.writing_eligible(r, screened(s), ids(spark, p)).collect())
    assert got([], []) == R[:2] == got([(R[0], "completed", "core")], R[:2])
    assert got([(R[0], "completed", "core"), (R[1], "completed", "Irrelevant")], R[:2]) == [R[0]]


def test_gaps_designs_and_theories(spark):
    cards = "theory_id string, verification_status string, host_review_status string, constructs array<string>, mechanisms array<string>, boundary_conditions array<string>, foundational_sources array<string>, review_sources array<string>, verification_notes string"
    c = spark.createDataFrame([("a", "candidate", "completed", ["x"], ["x"], ["x"], [], ["s"], "n"), ("b", "candidate", "completed", ["x"], [], ["x"], ["s"], [], "n"), ("c", "content-verified", "", [], [], [], [], [], ""), ("d", "odd", "", [], [], [], [], [], "")], cols := cards)
    assert {r["theory_id"]: r["verification_status"] for r in ledgers.advance_cards(c, ids(spark, ["a"], "theory_id")).collect()} == {"a": "source-located", "b": "candidate", "c": "content-verified", "d": "odd"} and cols
    again = ledgers.advance_cards(ledgers.advance_cards(c, ids(spark, [], "theory_id")), ids(spark, ["a"], "theory_id"))
    assert again.where("theory_id = 'a'").first()["verification_status"] == "content-verified"
    assert {(r["rule"], r["id"]) for r in ledgers.card_violations(c).collect()} == {("unknown-state", "d"), ("verified-without-source", "c")}
    fits = spark.createDataFrame([("a", "adopt", "candidate", True, "r", "ok", "ok", ["x", "y"]), ("b", "adopt", "content-verified", None, "r", "unchecked", "ok", []), ("c", "no", "content-verified", None, "r", "ok", "ok", [])], "theory_id string, decision string, verification_status string, source_verified boolean, fit_rationale string, assumption_fit string, boundary_fit string, competing_theories array<string>")
    assert {r["theory_id"]: r["adopted"] for r in ledgers.adopted_theories(fits).collect()} == {"a": True, "b": False}
    rivals = ledgers.competing_theories(fits.select("*", F.lit("n").alias("name"), F.lit("t").alias("explanatory_target"), F.lit("p").alias("discriminating_prediction")))
    assert rivals.count() == 2
    methods = spark.createDataFrame([("m1", ["g"]), ("m2", ["h"])], "method_id string, goals array<string>")
    rec = spark.createDataFrame([("G1", "m1", ["g"]), ("G1", "m2", ["g"]), ("G1", "m9", ["g"])], "gap_id string, method_id string, goals array<string>")
    gaps = spark.createDataFrame([("G1", "validated", "q", "d"), ("G2", "opportunity", "", "d"), ("G3", "dropped", "", "")], "gap_id string, status string, research_questions string, design_requirements string")
    assert {(r["rule"], r["id"]) for r in ledgers.design_violations(rec, methods, gaps).collect()} == {("unknown-method", "m9"), ("unfit-method", "m2"), ("gap-without-question", "G2"), ("gap-without-method", "G2")}
    bad = spark.createDataFrame([("G1", [R[0], R[9], "note"])], "gap_id string, failure_evidence array<string>")
    assert [tuple(r) for r in ledgers.gap_violations(bad, ids(spark, R[:2])).collect()] == [("unknown-record", "G1")]
    name = lambda *a: spark.range(1).select(ledgers.theory_name(*map(F.lit, a)).alias("n")).first()["n"]
    assert name("index", "自我决定理论", "", "x") == "自我决定理论" and name("a_file", "p", "", "# no name\n- Social exchange theory of x") == "Social exchange theory" and name("index", "", "", "") == "Unnamed theory candidate"


def test_matrices(spark):
    rel = "array<struct<subject:string,predicate:string,object:string,direction:string,status:string,anchor:string>>"
    e = spark.createDataFrame([(R[0], "completed", "abstract", "survey", ["T"], [("a", "b", "c", "+", "mixed", "x"), ("a", "b", "d", "+", "support", "y")], ["k"], ["m", "n"]), (R[1], "pending", "abstract", "survey", ["U"], [], [], [])], f"record_id string, host_review_status string, evidence_level string, design string, theories array<string>, relations {rel}, contexts array<string>, methods array<string>")
    m = ledgers.matrices(e)
    assert [m[k].count() for k in ("theories", "relations", "methods", "adverse")] == [1, 2, 1, 1] and m["methods"].first()["methods"] == "m; n"
    g = spark.createDataFrame([("a", "unsupported", "strong", 2), ("b", "partial", "strong", 4)], "claim string, support_check string, claim_status string, studies int")
    assert {(r["rule"], r["id"]) for r in ledgers.claim_group_violations(g).collect()} == {("unsupported", "a"), ("strong-under-three-studies", "a"), ("strong-on-partial-support", "b")}


def test_plans():
    good = {"approved": True, "status": "approved", "core_groups": [{"id": "a", "terms": ["x"], "required": True}]}
    assert plans.check_focus_plan(good) == {"valid": True, "errors": [], "warnings": [], "usable_core_groups": 1, "required_core_groups": 1}
    assert plans.check_focus_plan({"minimum_core_groups": 3, "unmatched_action": "drop"})["errors"] == ["not-approved", "no-usable-group", "minimum-out-of-range", "unknown-unmatched-action"]
    assert plans.check_search_plan({"queries": ["deep learning"], "title_or_idea": "Deep learning"})["valid"]
    bad = plans.check_search_plan({"title_or_idea": "深度学习", "queries": [{"id": "Q1", "language": "en", "query": "深度"}]})
    assert bad["errors"] == ["language-differs:Q1", "title-zh-missing", "title-en-missing", "translation-not-completed", "no-bilingual-concept", "no-chinese-core-query", "no-english-core-query"]
    full = {"title_or_idea": "深度学习", "title_zh": "深度学习", "title_en": "Deep learning", "translation_status": "completed", "concepts": [{"name": "c", "zh": ["深度"], "en": ["deep"]}], "queries": [{"language": "zh", "query": "深度"}, {"language": "en", "query": "deep"}]}
    assert plans.check_search_plan(full)["valid"]


def test_documents(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Methods</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>We </w:t></w:r><w:r><w:t>did.</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(out.getvalue())
    (tmp_path / "b.MD").write_text("﻿# Abstract\nx\n1. Introduction and more\n")
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.doc").write_bytes(b"old")
    (tmp_path / "e.xyz").write_text("no")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in documents.read_texts(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.docx", "b.MD", "c.docx", "d.doc"} and rows["c.docx"]["error"].startswith("BadZipFile") and "docx" in rows["d.doc"]["error"]
    assert (rows["a.docx"]["paragraphs"], rows["a.docx"]["tables"]) == (2, 1) and "## [paragraph:1] Methods" in rows["a.docx"]["text"] and "[paragraph:3] We did." in rows["a.docx"]["text"] and "| a | b |" in rows["a.docx"]["text"]
    assert rows["b.MD"]["text"].startswith("<!-- line:1 -->\n# Abstract") and len(rows["b.MD"]["sha256"]) == 64
    found = documents.detect_sections(documents.read_texts(spark, str(tmp_path)).where("path like '%b.MD'"))
    assert [(r["line"], r["name"]) for r in found.orderBy("line").collect()] == [(2, "abstract"), (6, "introduction")]


def test_sinks(spark, tmp_path):
    from litweave.functions import records

    c = records.canonical(spark.createDataFrame([("One | two", "10.1/x", "a;b"), ("Three", None, None)], "title string, doi string, keywords string"), "f", "n")
    sinks.write_corpus(c, str(tmp_path / "corpus"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "corpus/records.csv")).where("doi = '10.1/x'").first()["keywords"] == "a; b"
    assert spark.read.json(str(tmp_path / "corpus/corpus.jsonl")).count() == 2 and "One | two" in "".join(r["value"] for r in spark.read.text(str(tmp_path / "corpus/records.md")).collect())
    t = spark.createDataFrame([(1, "a|b"), (2, None)], "n int, s string").orderBy("n")
    assert sinks.markdown_table("T", t, 1) == "# T\n\n- rows_total: 2\n\n| n | s |\n|---|---|\n| 1 | a\\|b |\n"
    sinks.write_tables({"t": t}, str(tmp_path / "tables"))
    assert spark.read.parquet(str(tmp_path / "tables/parquet/t")).count() == 2
    merged = spark.createDataFrame([("a", [("merged", "b", "title-year-author", 0.95), ("merged", "c", "title-year-author", 0.99), ("merged", "d", "openalex", 0.5)])], "record_id string, audit array<struct<action:string,other_id:string,method:string,score:double>>")
    assert [tuple(r) for r in sinks.review_queue(merged).collect()] == [("a", "b", 0.95)]


def test_pages():
    body, contents = sinks.page_body("# A *b* <c>\n\none\ntwo **x** `y` [l](u)\n- item\n2) second\n> said\n```\n<code>\n\nx\n```\nend")
    assert contents == [("h1", "A *b* <c>")]
    assert body == '<h1 id="h1">A <em>b</em> &lt;c&gt;</h1>\n<p>one two <strong>x</strong> <code>y</code> <a href="u">l</a></p>\n<ul><li>item</li></ul>\n<ol><li>second</li></ol>\n<blockquote>said</blockquote>\n<pre><code>&lt;code&gt;\n\nx</code></pre>\n<p>end</p>'
    assert '<a href="#h1">' in sinks.page("t", "# A") and "<script" not in sinks.page("<script>", "x")


def test_export_gate(spark):
    from litweave.functions.records import content_hash

    d = spark.createDataFrame([(1, f"研究 [cite:{R[1]}]。"), (2, f"研究 [cite:{R[1]}]。")], "doc int, text string")
    ok = d.select("doc", content_hash(F.col("text")).alias("approved_sha256"), content_hash(F.col("text")).alias("validated_sha256"))
    ris = spark.createDataFrame([(1, f"TY  - JOUR\nID  - {R[1]}\nER  -"), (2, f"TY  - JOUR\nID  - {R[2]}\nER  -")], "doc int, ris string")
    assert [tuple(r) for r in sinks.export_problems(d, "doc", "text", ok, ris, review.PUNCTUATION).collect()] == [(2, "references-differ-from-citations")]


def test_enrichment(spark):
    d = spark.createDataFrame([([[2020, 3], [2019]],), ([None, [2019, 1, 2]],), ([None, None],)], "p array<array<int>>")
    assert [r[0] for r in d.select(parsers.partial_date(F.col("p")[0], F.col("p")[1])).collect()] == ["2020-03", "2019-01-02", None]


def test_numbers_of_rows(spark):
    rows = [(i * 7 % 501,) for i in range(500)]
    got = numbered(spark.createDataFrame(rows, "k int").repartition(7), "k").collect()
    assert sorted((r["k"], r["number"]) for r in got) == [(k, i + 1) for i, (k,) in enumerate(sorted(rows))]
    assert numbered(spark.createDataFrame([], "k int"), "k").count() == 0


def test_effects_are_rejected_with_reasons(spark):
    cols = "effect_id string, outcome string, metric string, sample_id string, anchor string, estimate double, standard_error double, ci_low double, ci_high double, n long, moderator double, subgroup string, record_id string, extraction_status string"
    row = lambda i, **k: tuple(({"effect_id": i, "outcome": "o", "metric": "hedges-g", "sample_id": i, "anchor": "p", "estimate": 0.2, "standard_error": 0.1, "ci_low": None, "ci_high": None, "n": None, "moderator": None, "subgroup": "a", "record_id": R[0], "extraction_status": "completed"} | k).values())
    rows = [row("a"), row("b", metric="d"), row("c", anchor=" "), row("d", metric="r", estimate=1.2), row("e", sample_id="a"), row("f", standard_error=None), *[row(f"g{i}", subgroup="b", estimate=0.5) for i in range(3)], *[row(f"h{i}") for i in range(2)], row("z", record_id="x")]
    e = spark.createDataFrame(rows, cols)
    assert {r["effect_id"] for r in meta.rejected(e).collect()} == {"b", "c", "d", "f"}
    assert {r["effect_id"] for r in meta.duplicate_samples(e).collect()} == {"a", "e"}
    sub = {r["subgroup"]: (r["studies"], round(r["pooled"], 6)) for r in meta.subgroups(meta.valid_effects(e)).collect()}
    assert sub == {"a": (4, 0.2), "b": (3, 0.5)}
    assert {(r["effect_id"], r["rule"]) for r in meta.effect_violations(e, ids(spark, [R[0]])).collect()} == {("c", "missing anchor"), ("z", "unknown record_id")}
    # a confidence interval of a ratio or a correlation is taken on the scale that is pooled
    x = spark.createDataFrame([("or", 2.0, 1.0, 4.0), ("r", 0.5, 0.2, 0.7), ("hedges-g", 0.5, 0.1, 0.9)], "m string, e double, l double, h double")
    import math

    from litweave.operators.evidence import working_scale

    none = F.lit(None).cast("double")
    s = [r["s"] for r in x.select(working_scale(F.col("m"), F.col("e"), none, F.col("l"), F.col("h"), none).alias("w")).select("w.s").collect()]
    assert s == pytest.approx([math.log(4) / 3.91992796908, (math.atanh(0.7) - math.atanh(0.2)) / 3.91992796908, 0.8 / 3.91992796908])


def test_library_as_zip(spark, tmp_path):
    c = spark.createDataFrame([("T1", "a", ["x"]), ("T2", "b", [])], "theory_id string, name string, aliases array<string>")
    path = str(tmp_path / "cards.zip")
    assert sinks.pack_library(c, path) == 2
    with zipfile.ZipFile(path, "a") as z:
        z.writestr("../out.json", "{}")
    back, bad = sinks.unpack_library(spark, path, c.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, c.collect())) and bad == ["../out.json"]
