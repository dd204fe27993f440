"""Drafts: their sections, citations, sentences and atomic claims, and audits of them against evidence."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.manuscript import atomic_units, signal
from ..functions.text import alignment_terms, claim_ids

#: Marks in drafts (fixed values).
RECORD, SOURCE, CLAIM = r"R[0-9a-f]{14}", r"SCTX-\d{3,}", r"C\d{4}"
ROLE, COMMENT = r"(?i)\[role:([a-z-]+)\]", r"<!--[\s\S]*?-->"
CITED = rf"(?i)\[cite:(?:{RECORD}|{SOURCE})(?:[,;]\s*(?:{RECORD}|{SOURCE}))*\]"
MARKER = r"\[(?:cite:)?[^\]]+\]"
STOPS = r"(?<=[。！？!?])\s*"
REFERENCES = r"(?m)^##\s+参考文献.*$"
YEAR_AT_END = r"[ \t]*[\(（][^()\n（）]*(?:19|20)\d{2}[^()\n（）]*[\)）](?=[。！？.!?]?$)"
INTRODUCTION_ROLES = ("social-importance", "context-narrowing", "research-progress", "theoretical-tension", "competing-mechanisms", "boundary", "gap", "objective", "contribution")
CHAPTER = r"^\s*(?:第[一二三四五六七八九十百]+[章节部分]|\d+(?:\.\d+)*[.、)）]?)\s*"
#: Signals in paragraphs (fixed values).
SYNTHESIS = r"(?i)因此|由此|据此|综合(?:来看|而言|上述)?|总体而言|这(?:表明|说明|意味着)|可见|换言之|共同表明|归纳而言|上述分歧|然而|但是?|这一差异|therefore|thus|taken together|overall|however|this (?:suggests|indicates|implies)"
THEORY_ROLE = r"(?i)总框架|主框架|局部|机制|边界|竞争|互补|嵌套|分工|分别|用于|负责|解释|补充|overarching|mechanis|boundary|competing|complementar|distinct role"
WEAK_NOVELTY = r"(?i)首次(?:采用|使用|引入|应用|研究)|未(?:采用|使用).{0,12}(?:方法|模型)|没有(?:采用|使用)|新方法|新模型|在.{0,16}(?:国家|地区|平台|情境|场景).{0,16}(?:开展|检验|研究)|first (?:use|apply|study)|new (?:country|context|platform|method)"
CONSEQUENCE = r"(?i)理论边界|假设|识别|推断|机制|测量|外部效度|竞争解释|知识后果|因果|theoretical boundary|identif|infer|mechanis|measurement|external validity|competing explanation"
JOINED_THEORIES, THEORY_WORDS = r"(?:以及|及|和|与)(?=[一-鿿A-Za-z·-]{2,18}(?:理论|模型|框架|视角))", "(理论|模型|框架|视角)"
ENUMERATED = "(、|(?:以及|并且|同时|分别|和|与))"
CITATION_ONLY = r"[\s(（][^()（）]*(?:19|20)\d{2}[^()（）]*[)）]\s*[.。]?”?"
PROPOSITION = r"(?i)本研究(?:提出|认为|拟|将)|有待(?:检验|验证)|需要(?:检验|验证)|仍需.{0,24}(?:检验|验证)|待检验命题|可检验(?:模型|命题)|理论命题|候选(?:中介|机制|解释)|可能|尚待|尚未|未(?:经|获|被|能|建立|解释)|不构成|不是已经"
#: What is taken out of a draft before delivery, in this order (fixed patterns): (pattern, replacement).
_TOKEN = rf"(?:{RECORD}|{CLAIM}|{SOURCE})"
CLEANING = (
    (r"(?s)<!--.*?-->", ""), (r"(?i)[ \t]*\[role:[a-z-]+\]", ""), (r"(?i)[ \t]*\\?\[\s*C\d{4}\s*[–—-]\s*C\d{4}\s*\\?\]", ""),
    (rf"(?i)[\(（][ \t]*(?:{RECORD}|{CLAIM})(?:[ \t]*[,;，；][ \t]*(?:{RECORD}|{CLAIM}|page:\d+|paragraph:\d+))*[ \t]*[\)）]", ""),
    (rf"(?i)[ \t]*\\?\[(?:cite:)?[ \t]*{_TOKEN}(?:[ \t]*[,;，；][ \t]*{_TOKEN})*[ \t]*\\?\]", ""),
    (rf"[ \t]*{RECORD}\b", ""), (rf"[ \t]*{SOURCE}\b", ""), (r"[ \t]*(?:page|paragraph):\d+\b", ""), (r"\*\*(.+?)\*\*", "$1"),
    (r"[\(（]\s*[;；,，]\s*[\)）]", ""), (r"[；;]{2,}", "；"), (r"[，,]\s*[；;]", "；"), (r"[；;]\s*[，,]", "；"), (r"\[\s*[,;，；–—-]+\s*\]", ""), (r"\n{3,}", "\n\n"),
)


def ids_in(text: Column, pattern: str) -> Column:
    """The distinct marks of one kind in a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))))


def stripped(text: Column) -> Column:
    """A text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def plain(text: Column) -> Column:
    """A sentence without its marks."""
    return F.trim(F.regexp_replace(text, MARKER, ""))


def digest(prefix: str, *parts: Column | str) -> Column:
    """``prefix`` and 14 hex digits of the SHA-256 of the parts between bars."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *cols).cast("binary"), 256), 1, 14))


def clean_markers(text: Column) -> Column:
    """A draft without comments, roles, ids and what is left of the brackets around them."""
    for pattern, new in CLEANING:
        text = F.regexp_replace(text, pattern, new)
    return F.concat(F.trim(text), F.lit("\n"))


def body(text: Column) -> Column:
    """What stands before the references."""
    return F.rtrim(F.get(F.split(text, REFERENCES, 2), F.lit(0)))


def embedded_references(text: Column) -> Column:
    """The ids of the records that a draft's references name, in their order and as often as they stand there."""
    at = F.length(F.get(F.split(text, REFERENCES, 2), F.lit(0)))
    return F.regexp_extract_all(F.substring(text, at + 1, F.length(text)), F.lit(rf"<!--\s*record:({RECORD})\s*-->"), F.lit(1))


def normal_heading(title: Column) -> Column:
    """A heading in lower case without its number, of letters a-z, digits and CJK characters only."""
    return F.regexp_replace(F.regexp_replace(F.lower(title), CHAPTER, ""), r"[^0-9a-z一-鿿]+", "")


def sections(drafts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, section_id, title, normal): headings of the second level, with the id that a comment on the line before gives."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)((?:<!--\s*section:[A-Za-z0-9_.-]+\s*-->[ \t]*\n)?^##[ \t]+[^\n]+$)"), F.lit(1))
    s = drafts.select(key, F.posexplode(found).alias("place", "s"))
    title = F.trim(F.regexp_extract("s", r"(?m)^##[ \t]+([^\n]+)$", 1))
    return s.select(key, F.col("place").cast("long").alias("place"), F.regexp_extract("s", r"section:([A-Za-z0-9_.-]+)", 1).alias("section_id"), title.alias("title"), normal_heading(title).alias("normal"))


def unexpected_sections(actual: DataFrame, approved: DataFrame, key: str, least: float = 0.72) -> DataFrame:
    """Sections of drafts that no approved section of the same key stands for: by id where both name ids, else by like headings.

    Headings are alike if they are equal, or four characters or longer with a ratio of ``least`` or more. Both lists are short.
    """
    ids = approved.where("section_id <> ''").groupBy(key).agg(F.collect_set("section_id").alias("ids"))
    names = approved.groupBy(key).agg(F.collect_set("normal").alias("names"))
    a = actual.join(names, key).join(ids, key, "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            like = lambda x, y: x == y or (min(len(x), len(y)) >= 4 and SequenceMatcher(None, x, y).ratio() >= least)
            known = [s in i if s and i is not None else any(like(n, m) for m in ns) for s, i, n, ns in zip(pdf["section_id"], pdf["ids"], pdf["normal"], pdf["names"], strict=True)]
            yield pdf.loc[[not k for k in known], [key, "place", "title"]]

    kind = actual.schema[key].dataType.simpleString()
    return a.mapInPandas(run, f"{key} {kind}, place bigint, title string")


def cited_records(drafts: DataFrame, key: str, text: str, ledger: DataFrame) -> DataFrame:
    """(key, record_id): records that a draft names, or that a claim (claim_id, record_ids) which it names rests on."""
    direct = drafts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\b({RECORD})\b"), F.lit(1)))).alias("record_id"))
    named = drafts.select(key, F.explode(claim_ids(F.col(text))).alias("claim_id")).join(ledger.select("claim_id", "record_ids"), "claim_id")
    return direct.unionByName(named.select(key, F.explode("record_ids").alias("record_id"))).distinct()


def paragraphs(drafts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, paragraph, role, text): prose before the references, without comments, headings and role marks; paragraphs count all blocks."""
    whole = F.regexp_replace(F.get(F.split(text, r"(?im)^##\s+参考文献\s*$", 2), F.lit(0)), COMMENT, "")
    p = drafts.select(key, F.posexplode(F.split(whole, r"\n\s*\n")).alias("i", "p")).where(F.col("p").rlike(r"\S") & ~F.col("p").rlike(r"^\s*#"))
    return p.select(key, (F.col("i") + 1).cast("long").alias("paragraph"), F.regexp_extract("p", ROLE, 1).alias("role"), stripped(F.regexp_replace("p", ROLE, "")).alias("text"))


def sentences(drafts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, paragraph, role, place, sentence)."""
    s = paragraphs(drafts, key, text).select(key, "paragraph", "role", F.posexplode(F.split("text", STOPS)).alias("place", "s"))
    return s.where("trim(s) <> ''").select(key, "paragraph", "role", F.col("place").cast("long").alias("place"), F.trim("s").alias("sentence"))


#: What a review of a sentence or of an atomic claim settles.
REVIEWED = ("support_status", "evidence_level", "claim_scope", "audit_notes", "design_fit")


def prior_reviews(rows: DataFrame, reviews: DataFrame, keys: list[str], key: str, fields: tuple[str, ...] = REVIEWED) -> DataFrame:
    """``rows`` with the ``fields`` of the first of ``keys`` under which ``reviews`` (key, fields) has an entry; null without one.

    One row of ``reviews`` for a key: of several the greatest.
    """
    one = reviews.groupBy(key).agg(F.max(F.struct(*[F.col(f) for f in fields])).alias("x"))
    out = rows
    for i, k in enumerate(keys):
        out = out.join(one.select(F.col(key).alias(f"_k{i}"), F.col("x").alias(f"_x{i}")), F.col(k) == F.col(f"_k{i}"), "left")
    found = F.coalesce(*[F.col(f"_x{i}") for i in range(len(keys))])
    return out.select(*rows.columns, *[found[f].alias(f) for f in fields])


def sentence_ledger(drafts: DataFrame, key: str, text: str, document: str, scope: str, reviews: DataFrame, records: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for each sentence: its id, marks, what a review of it said, ``errors`` and ``reasons`` for repair.

    A sentence's id is a digest of its text without marks and closing citation, so that a review (sentence_id, REVIEWED)
    goes stale when the sentence changes; ids of older ledgers, without the scope, count too. ``records`` (record_id) and
    ``sources`` (source_id) are what may be cited.
    """
    s = sentences(drafts, key, text).withColumn("plain", plain(F.col("sentence")))
    meaning = F.trim(F.regexp_replace("plain", YEAR_AT_END, ""))
    s = s.select("*", digest("S", document, scope, meaning).alias("sentence_id"), digest("S", document, F.col("plain")).alias("_old"), digest("S", document, meaning).alias("_old_meaning"))
    s = s.withColumn("record_ids", ids_in(F.col("sentence"), RECORD)).withColumn("source_ids", ids_in(F.col("sentence"), SOURCE)).withColumn("claim_ids", ids_in(F.col("sentence"), r"(?:SC|C)\d{4}")).withColumn("factual", signal(F.col("plain"), "factual"))
    s = prior_reviews(s, reviews, ["sentence_id", "_old", "_old_meaning"], "sentence_id").drop("_old", "_old_meaning")
    fresh = F.when(F.col("factual"), "pending").otherwise("not-applicable")
    s = s.withColumn("support_status", F.coalesce("support_status", fresh)).withColumn("design_fit", F.coalesce("design_fit", fresh))

    def unknown(ids: str, known: DataFrame, name: str) -> DataFrame:
        each = s.select(key, "paragraph", "place", F.explode(ids).alias(name)).join(known.select(name).distinct(), name, "left_anti")
        return each.groupBy(key, "paragraph", "place").agg(F.array_sort(F.collect_set(name)).alias(f"unknown_{ids}"))

    at = [key, "paragraph", "place"]
    s = s.join(unknown("record_ids", records, "record_id"), at, "left").join(unknown("source_ids", sources, "source_id"), at, "left")
    status, factual = F.col("support_status"), F.col("factual")
    bound = (F.size("record_ids") > 0) | (F.size("source_ids") > 0)
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    settled = factual & status.isin("supported", "partial")
    lacking = empty("evidence_level") | empty("claim_scope") | empty("audit_notes") | ~bound
    checks = {
        "unknown-record-ids": F.col("unknown_record_ids").isNotNull(), "unknown-source-ids": F.col("unknown_source_ids").isNotNull(), "missing-exact-sentence-citation": factual & ~bound,
        "citation-does-not-support-sentence": factual & (status == "unsupported"), "semantic-support-not-reviewed": factual & (status == "pending"), "partial-support-without-note": factual & (status == "partial") & empty("audit_notes"),
        "incomplete-support-audit": settled & lacking, "causal-wording-without-design-fit": signal(F.col("plain"), "causal") & ~F.col("design_fit").isin("causal-design", "causal-language-narrowed"),
        "citation-only-fragment": F.col("plain").rlike(f"^{CITATION_ONLY}$"),
    }
    repair = ("missing-exact-sentence-citation", "citation-does-not-support-sentence", "semantic-support-not-reviewed", "incomplete-support-audit", "citation-only-fragment")
    errors = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    s = s.withColumn("errors", errors)
    return s.withColumn("reasons", F.filter("errors", lambda e: e.isin(*repair))).drop("unknown_record_ids", "unknown_source_ids")


def repair_queue(ledger: DataFrame, key: str) -> DataFrame:
    """Sentences to be repaired, with the records that their paragraph cites, in the order of their first place."""
    ids = ledger.select(key, "paragraph", "place", F.posexplode("record_ids").alias("i", "id")).groupBy(key, "paragraph", "id").agg(F.min(F.struct("place", "i")).alias("at"))
    listed = ids.groupBy(key, "paragraph").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("paragraph_record_ids"))
    q = ledger.where(F.size("reasons") > 0).join(listed, [key, "paragraph"], "left")
    return q.select(key, "paragraph", "place", "sentence_id", "plain", "reasons", F.coalesce("paragraph_record_ids", F.array().cast("array<string>")).alias("paragraph_record_ids"))


def repeated_bindings(ledger: DataFrame, key: str) -> DataFrame:
    """(key, paragraph): paragraphs in which three sentences or more cite the very same ids."""
    b = ledger.select(key, "paragraph", F.concat("record_ids", "source_ids").alias("b")).where(F.size("b") > 0)
    return b.groupBy(key, "paragraph").agg(F.count("*").alias("n"), F.countDistinct("b").alias("kinds")).where("n >= 3 and kinds = 1").select(key, "paragraph")


def atomic_ledger(ledger: DataFrame, key: str, document: str, variant: str, scope: str, reviews: DataFrame) -> DataFrame:
    """One row for each atomic claim of a sentence ledger, with its review, ``reasons`` for repair and whether it is complete.

    Claims are parted at semicolons outside of brackets. A sentence that is one claim hands its own review down.
    """
    from_sentence = [F.col(f).alias(f"_{f}") for f in REVIEWED]
    parents = F.concat("record_ids", "source_ids")
    enumerated = F.size(F.regexp_extract_all(F.regexp_replace("sentence", CITED, ""), F.lit(ENUMERATED), F.lit(1)))
    groups = F.size(F.regexp_extract_all("sentence", F.lit(f"({CITED})"), F.lit(1)))
    units = atomic_units(F.col("sentence"))
    a = ledger.select(key, "paragraph", "place", "sentence_id", *from_sentence, units.alias("units"), parents.alias("parent_ids"), ((F.size(units) > 1) & (F.size(parents) >= 8) & (enumerated >= 2) & (groups <= 1)).alias("_cluster"))
    a = a.select("*", F.posexplode("units").alias("unit", "claim")).withColumn("claim_text", plain(F.col("claim")))
    a = a.withColumn("atomic_claim_id", digest("A", document, variant, scope, F.col("sentence_id"), F.col("claim_text"))).withColumn("record_ids", ids_in(F.col("claim"), RECORD)).withColumn("source_ids", ids_in(F.col("claim"), SOURCE)).withColumn("factual", signal(F.col("claim_text"), "factual"))
    a = prior_reviews(a, reviews, ["atomic_claim_id"], "atomic_claim_id", REVIEWED[:4])
    bound = (F.size("record_ids") > 0) | (F.size("source_ids") > 0)
    handed = (F.size("units") == 1) & F.col("_support_status").isin("supported", "partial") & bound
    for f in REVIEWED[:4]:
        a = a.withColumn(f, F.when(handed, F.col(f"_{f}")).otherwise(F.col(f)))
    a = a.withColumn("support_status", F.coalesce("support_status", F.when(F.col("factual"), "pending").otherwise("not-applicable")))
    checks = {"atomic-claim-lacks-exact-citation": F.col("factual") & (F.size("units") > 1) & ~bound & (F.size("parent_ids") > 0), "heterogeneous-claims-share-one-large-citation-cluster": F.col("factual") & F.col("_cluster")}
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    whole = F.col("support_status").isin("supported", "partial") & bound & some("evidence_level") & some("claim_scope") & some("audit_notes")
    return a.select(key, "paragraph", "place", (F.col("unit") + 1).cast("long").alias("unit"), "sentence_id", "atomic_claim_id", "claim_text", "factual", "record_ids", "source_ids", *REVIEWED[:4], F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()])).alias("reasons"), whole.alias("complete"))


def traceability(ledger: DataFrame, atomic: DataFrame, key: str) -> DataFrame:
    """(key, problem, at): what keeps a draft from being traceable: no factual rows, and rows that are not bound to evidence in full."""
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    bound = (F.size("record_ids") > 0) | (F.size("source_ids") > 0) | (F.size("claim_ids") > 0)
    whole = F.col("support_status").isin("supported", "partial") & bound & some("evidence_level") & some("claim_scope") & some("audit_notes")
    prose = ledger.where("factual").groupBy(key).agg(F.count("*").alias("prose"))
    claims = atomic.where("factual").groupBy(key).agg(F.count("*").alias("claims"))
    n = ledger.select(key).distinct().join(prose, key, "left").join(claims, key, "left").fillna(0, ["prose", "claims"])
    none = F.lit(None).cast("string")
    parts = [
        n.where("prose = 0").select(key, F.lit("no-factual-sentences").alias("problem"), none.alias("at")), n.where("prose > 0 and claims = 0").select(key, F.lit("no-atomic-claims").alias("problem"), none.alias("at")),
        ledger.where(F.col("factual") & ~whole).select(key, F.lit("sentence-not-bound").alias("problem"), F.col("sentence_id").alias("at")), atomic.where("factual and not complete").select(key, F.lit("atomic-claim-not-bound").alias("problem"), F.col("atomic_claim_id").alias("at")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def quality_issues(drafts: DataFrame, key: str, text: str, document: str, most: int = 240) -> DataFrame:
    """(key, paragraph, issue_code, excerpt): prose that is likely to need work; none of it makes a draft invalid."""
    p = paragraphs(drafts, key, text)
    bare = F.regexp_replace("text", MARKER, "")
    cut = lambda c: F.substring(c, 1, most).alias("excerpt")
    q = p.withColumn("bare", bare)
    many = (F.size(ids_in(F.col("text"), RECORD)) >= 3) | (F.size(F.regexp_extract_all("text", F.lit(r"((?:19|20)\d{2})"), F.lit(1))) >= 3)
    several = F.size(F.filter(F.split("bare", STOPS), lambda s: F.trim(s) != "")) >= 2
    listed = F.regexp_replace("bare", JOINED_THEORIES, "、")
    theories = F.size(F.regexp_extract_all(listed, F.lit(THEORY_WORDS), F.lit(1)))
    checks = {
        "multiple-theories-without-role-division": (theories >= 3) & ~F.col("bare").rlike(THEORY_ROLE),
        "distribution-or-method-novelty-framed-as-contribution": signal(F.col("bare"), "contribution") & F.col("bare").rlike(WEAK_NOVELTY) & ~F.col("bare").rlike(CONSEQUENCE),
    }
    if document == "review":
        checks["literature-list-without-synthesis"] = several & many & ~F.col("bare").rlike(SYNTHESIS)
    found = q.select(key, "paragraph", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))).alias("issue_code"), cut(F.col("bare")))
    s = p.select(key, "paragraph", F.explode(F.split("text", STOPS)).alias("s")).withColumn("g", F.regexp_extract_all("s", F.lit(f"({CITED})"), F.lit(1)))
    opposed = s.where((F.size("g") == 1) & signal(F.col("s"), "opposing")).where(F.size(F.regexp_extract_all(F.get("g", F.lit(0)), F.lit(f"({RECORD})"), F.lit(1))) >= 2)
    found = found.unionByName(opposed.select(key, "paragraph", F.lit("opposing-evidence-shares-citation-cluster").alias("issue_code"), cut(F.col("s"))))
    if document == "introduction":
        by = p.where("role <> ''").groupBy(key, F.lower("role").alias("role")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "text"))), lambda x: x["text"]), " ").alias("t"))
        wide = drafts.select(key).distinct()
        for role in ("gap", "objective", "contribution", "research-progress"):
            wide = wide.join(by.where(F.col("role") == role).select(key, F.col("t").alias(role.replace("-", "_"))), key, "left")
        apart = lambda c: F.col("gap").isNotNull() & F.col(c).isNotNull() & ~F.arrays_overlap(alignment_terms(F.col("gap")), alignment_terms(F.col(c)))
        zero = F.lit(0).cast("long").alias("paragraph")
        for code, when, what in (
            ("introduction-missing-knowledge-baseline", F.col("research_progress").isNull(), F.lit("")), ("gap-objective-alignment-weak", apart("objective"), F.col("objective")), ("gap-contribution-alignment-weak", apart("contribution"), F.col("contribution")),
        ):
            found = found.unionByName(wide.where(when).select(key, zero, F.lit(code).alias("issue_code"), cut(what)))
    return found.distinct()


def missing_roles(drafts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, role): parts of an introduction's funnel that no paragraph has."""
    want = drafts.select(key).distinct().select(key, F.explode(F.array(*map(F.lit, INTRODUCTION_ROLES))).alias("role"))
    return want.join(paragraphs(drafts, key, text).select(key, F.lower("role").alias("role")).distinct(), [key, "role"], "left_anti")


def candidate_evidence(ids: DataFrame, records: DataFrame, extractions: DataFrame) -> DataFrame:
    """What is known of cited records (record_id): title, year and abstract from ``records``, level, design and directions from ``extractions``."""
    e = extractions.select("record_id", F.col("evidence_level").alias("_level"), "design", "relevance", F.array_sort(F.array_distinct(F.transform("relations", lambda r: F.coalesce(r["direction"], r["status"])))).alias("relation_directions"), "host_review_status")
    c = ids.select("record_id").distinct().join(records.select("record_id", "title", "year", "abstract"), "record_id", "left").join(e, "record_id", "left")
    level = F.coalesce("_level", F.when(F.coalesce("abstract", F.lit("")) != "", "abstract").otherwise("metadata"))
    return c.select("record_id", "title", "year", level.alias("evidence_level"), F.coalesce("design", F.lit("unclear")).alias("design"), F.coalesce("relevance", F.lit("")).alias("relevance"), F.coalesce(F.filter("relation_directions", lambda x: x != ""), F.array().cast("array<string>")).alias("relation_directions"), F.coalesce("host_review_status", F.lit("missing")).alias("host_review_status"))


def clean_reference(apa: Column) -> Column:
    """A reference with single spaces and stops, and none before commas, semicolons and colons."""
    t = F.trim(F.regexp_replace(apa, r"\s+", " "))
    for pattern, new in ((r"\.\s+\.(?=\s|$)", "."), (r"(?<!https:)(?<!http:)\.{2,}", "."), (r"\s+([,;:])", "$1")):
        t = F.regexp_replace(t, pattern, new)
    return t


def reference_list(drafts: DataFrame, key: str, text: str, ledger: DataFrame, registry: DataFrame) -> DataFrame:
    """(key, references, missing): the references of a draft's cited records by their text, whatever the case, and those the registry (record_id, apa) lacks."""
    used = cited_records(drafts.select(key, body(F.col(text)).alias(text)), key, text, ledger).join(registry.select("record_id", clean_reference(F.col("apa")).alias("apa")), "record_id", "left")
    entry = F.struct(F.lower("apa").alias("order"), F.concat(F.lit("<!-- record:"), "record_id", F.lit(" -->\n"), "apa").alias("entry"))
    g = used.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("apa").isNotNull(), entry))).alias("x"), F.array_sort(F.collect_list(F.when(F.col("apa").isNull(), F.col("record_id")))).alias("missing"))
    return g.select(key, F.array_join(F.transform("x", lambda x: x["entry"]), "\n\n").alias("references"), "missing")


def rewrite_queue(drafts: DataFrame, key: str, text: str, document: str, ledger: DataFrame, banned: dict[str, str]) -> DataFrame:
    """Sentences that keep a draft from publication: words of the workshop, partial support not put as a proposition, no support.

    ``ledger`` (plain, support_status) tells of sentences by their text without marks.
    """
    from .review import labels

    p = paragraphs(drafts, key, text).select(key, "paragraph", F.posexplode(F.split("text", STOPS)).alias("place", "sentence")).where("trim(sentence) <> ''")
    tidy = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, MARKER, ""), r"\s+", " "))
    known = ledger.groupBy(tidy(F.col("plain")).alias("_t")).agg(F.max("support_status").alias("support_status"))
    s = p.withColumn("_t", tidy(F.col("sentence"))).join(known, "_t", "left").withColumn("support_status", F.coalesce("support_status", F.lit("pending"))).withColumn("banned_terms", labels(F.col("sentence"), banned))
    checks = {"reader-facing-workflow-language": F.size("banned_terms") > 0, "partial-support-must-be-proposition": (F.col("support_status") == "partial") & ~F.col("sentence").rlike(PROPOSITION), "unsupported-claim-must-be-removed": F.col("support_status") == "unsupported"}
    action = F.when(F.col("support_status") == "partial", "rewrite-as-testable-proposition").when(F.col("support_status") == "unsupported", "remove").otherwise("rewrite-reader-facing")
    q = s.withColumn("reason_codes", F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()])))).where(F.size("reason_codes") > 0)
    order = F.row_number().over(W.partitionBy(key).orderBy("paragraph", "place"))
    return q.select(key, "paragraph", F.trim("sentence").alias("sentence"), "support_status", "banned_terms", "reason_codes", action.alias("required_action"), ids_in(F.col("sentence"), RECORD).alias("record_ids"), order.cast("long").alias("number"))


def delivery_defects(drafts: DataFrame, key: str, text: str, introduction: bool, punctuation: dict[str, str]) -> DataFrame:
    """(key, defect): what keeps a draft from delivery once its marks are gone: punctuation, ids left over, an introduction's shape."""
    from .review import labels

    clean = clean_markers(F.col(text))
    found = F.concat(labels(clean, punctuation), F.when(clean.rlike(rf"\b(?:{RECORD}|{CLAIM}|{SOURCE})\b"), F.array(F.lit("internal-ids"))).otherwise(F.array().cast("array<string>")))
    out = drafts.select(key, F.explode(found).alias("defect"))
    if introduction:
        blocks = F.filter(F.split(body(clean), r"\n\s*\n"), lambda p: (F.trim(p) != "") & ~F.startswith(F.ltrim(p), F.lit("#")))
        out = out.unionByName(drafts.where(~F.size(blocks).between(8, 12)).select(key, F.lit("paragraphs-out-of-range").alias("defect")))
    return out
