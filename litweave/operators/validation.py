"""One report over a corpus, its ledger and the drafts written from them: coverage, citations, references, sections, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import content_hash
from ..functions.text import claim_ids
from .drafts import body, cited_records, embedded_references
from .ledgers import ADVERSE, claim_violations, corpus_violations
from .stats import citation_minimum, topic_quota

#: Citations that a section needs, and words that claim too much (fixed pattern).
SECTION_MINIMUM = 2
ABSOLUTE = r"(?i)从未(?:有|被)?研究|完全空白|没有任何研究|never been studied|no studies have"


def coverage(drafts: DataFrame, key: str, text: str, ledger: DataFrame, eligible: DataFrame, topics: DataFrame) -> DataFrame:
    """(key, scope, part, available, cited, minimum, status): what each draft cites over all, of each topic, and in each section.

    ``eligible`` (record_id) may be cited, ``topics`` (record_id, topic_id) come from a model and are few. Sections are those of the second
    level before the references; they count every record that they cite, the rest only eligible ones. A null draft cites nothing.
    """
    d = drafts.select(key, body(F.coalesce(F.col(text), F.lit(""))).alias("_body"))
    ok = eligible.select("record_id").distinct()
    used = cited_records(d, key, "_body", ledger).join(ok, "record_id", "left_semi")
    total = ok.agg(F.count("*").alias("_total"))
    status = F.when(F.col("cited") >= F.col("minimum"), "pass").otherwise("fail")
    columns = [key, "scope", "part", "available", "cited", "minimum", status.alias("status")]
    cited = used.groupBy(key).agg(F.count("*").alias("_cited"))
    overall = d.select(key).crossJoin(F.broadcast(total)).join(cited, key, "left").select(key, F.lit("overall").alias("scope"), F.lit("").alias("part"), F.col("_total").alias("available"), F.coalesce("_cited", F.lit(0).cast("long")).alias("cited"), citation_minimum(F.col("_total")).alias("minimum"))
    of_topic = topics.select("record_id", "topic_id").distinct()
    sizes = of_topic.join(ok.withColumn("_ok", F.lit(1)), "record_id", "left").groupBy("topic_id").agg(F.count("_ok").alias("_size")).crossJoin(F.broadcast(total))
    by_topic = used.join(of_topic, "record_id").groupBy(key, "topic_id").agg(F.count("*").alias("_cited"))
    each = d.select(key).crossJoin(F.broadcast(sizes)).join(by_topic, [key, "topic_id"], "left")
    topic_rows = each.select(key, F.lit("topic").alias("scope"), F.col("topic_id").cast("string").alias("part"), F.col("_size").alias("available"), F.coalesce("_cited", F.lit(0).cast("long")).alias("cited"), topic_quota(F.col("_size"), F.col("_total")).cast("long").alias("minimum"))
    pieces = d.select(key, F.posexplode(F.split("_body", r"(?m)^##[ \t]+")).alias("_place", "_piece")).where("_place > 0")
    parts = pieces.select(F.struct(key, "_place").alias("_at"), F.trim(F.regexp_extract("_piece", r"^([^\n]*)", 1)).alias("part"), F.regexp_replace("_piece", r"^[^\n]*\n?", "").alias("_text"))
    in_part = cited_records(parts, "_at", "_text", ledger).groupBy("_at").agg(F.count("*").alias("_cited"))
    section_rows = parts.join(in_part, "_at", "left").crossJoin(F.broadcast(total)).select(F.col(f"_at.{key}").alias(key), F.lit("section").alias("scope"), "part", F.col("_total").alias("available"), F.coalesce("_cited", F.lit(0).cast("long")).alias("cited"), F.lit(SECTION_MINIMUM).cast("long").alias("minimum"))
    return overall.unionByName(topic_rows).unionByName(section_rows).select(*columns)


def draft_violations(drafts: DataFrame, key: str, text: str, ledger: DataFrame, records: DataFrame, eligible: DataFrame, topics: DataFrame, registry: DataFrame, audits: DataFrame) -> DataFrame:
    """(rule, severity, key, id): what is wrong in drafts.

    ``records`` (record_id, tier), ``registry`` (record_id) of references, ``audits`` (key, source_sha256) of the text that was audited; a draft
    without an audit is not stale. Claims are known by the ledger (claim_id, direction, record_ids).
    """
    d = drafts.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_body", body(F.col("_text")))
    used = cited_records(d, key, "_body", ledger)
    listed = d.select(key, F.explode(embedded_references(F.col("_text"))).alias("record_id"))
    claims = d.select(key, F.explode(claim_ids(F.col("_body"))).alias("claim_id")).distinct()
    adverse = ledger.where(F.col("direction").isin(*ADVERSE)).select("claim_id").distinct()
    some_adverse = adverse.limit(1).select(F.lit(True).alias("_any"))
    cover = coverage(drafts, key, text, ledger, eligible, topics).where("status = 'fail'")
    under = {"coverage-under-minimum": "overall", "topic-under-quota": "topic", "section-under-minimum": "section"}
    own = audits.select(key, "source_sha256")
    errors = {
        "unknown-claim": claims.join(ledger.select("claim_id"), "claim_id", "left_anti").select(key, F.col("claim_id").alias("id")),
        "tier-d-cited": used.join(records.where("tier = 'D'").select("record_id"), "record_id", "left_semi").select(key, F.col("record_id").alias("id")),
        "unregistered-reference": used.join(registry.select("record_id"), "record_id", "left_anti").select(key, F.col("record_id").alias("id")),
        "no-references": d.join(listed.select(key), key, "left_anti").select(key, F.lit("").alias("id")),
        "reference-repeated": listed.groupBy(key, "record_id").count().where("count > 1").select(key, F.col("record_id").alias("id")),
        "cited-not-listed": used.join(listed, [key, "record_id"], "left_anti").select(key, F.col("record_id").alias("id")),
        "listed-not-cited": listed.distinct().join(used, [key, "record_id"], "left_anti").select(key, F.col("record_id").alias("id")),
        "stale-audit": d.join(own, key).where(F.col("source_sha256") != content_hash(F.col("_text"))).select(key, F.lit("").alias("id")),
    } | {rule: cover.where(F.col("scope") == scope).select(key, F.col("part").alias("id")) for rule, scope in under.items()}
    warnings = {
        "todo": d.where(F.contains("_body", F.lit("TODO"))).select(key, F.lit("").alias("id")), "absolute-gap": d.where(F.col("_body").rlike(ABSOLUTE)).select(key, F.lit("").alias("id")),
        "adverse-claims-unused": d.join(claims.join(adverse, "claim_id", "left_semi").select(key), key, "left_anti").crossJoin(F.broadcast(some_adverse)).select(key, F.lit("").alias("id")),
    }
    out = None
    for severity, rules in (("error", errors), ("warning", warnings)):
        for rule, found in rules.items():
            one = found.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), key, "id")
            out = one if out is None else out.unionByName(one)
    return out


def validation_report(corpus: DataFrame, claim_rules: tuple, draft_rules: tuple) -> DataFrame:
    """(part, rule, severity, subject, id): the violations of a corpus, of its ledger and of its drafts as one table; valid is what has no error.

    ``claim_rules`` and ``draft_rules`` are what ``claim_violations`` and ``draft_violations`` are called with. Retracted works are warnings.
    """
    severity = F.when(F.col("rule") == "retracted", "warning").otherwise("error")
    nothing = F.lit("").alias("subject")
    own = corpus_violations(corpus).select(F.lit("corpus").alias("part"), "rule", severity.alias("severity"), nothing, "id")
    claims = claim_violations(*claim_rules).select(F.lit("claims").alias("part"), "rule", F.lit("error").alias("severity"), nothing, "id")
    drafts = draft_violations(*draft_rules).select(F.lit("drafts").alias("part"), "rule", "severity", F.col(draft_rules[1]).cast("string").alias("subject"), "id")
    return own.unionByName(claims).unionByName(drafts)
