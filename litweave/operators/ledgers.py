"""Ledgers of claims, extractions, gaps, designs and theories: how they are built, which rows may be written from, and what is wrong in them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.manuscript import DIAGNOSED, FRAGMENT_GAP, WEAK_GAP, gap_goals, normalize_gaps, runs_of
from ..functions.text import normalize_title
from ..storage import hold, numbered
from .dedup import ratio, squeezed
from .evidence import evidence_tier, publication_type, quality, study_design, tier_rank, violations
from .review import ADVERSE_STATUSES, overlap_top

#: Words of a screening that keep a record out of writing, and words of cause (fixed values).
BLOCKED = r"peripheral|irrelevant|homonym|prohibit"
CAUSE = r"(?i)\b(causes?|leads? to|results? in|drives?|determines?)\b|导致|引起|决定|驱动"
NONCAUSAL = ("survey", "cross-sectional", "qualitative", "review", "unclear")
ANCHOR = r"(?:page|paragraph):\d+"
STRONG, ADVERSE = ("high", "strong"), ("contradict", "mixed")
#: States of a theory card, shares of sections, and how names of theories are found (fixed values and patterns).
THEORY_STATES = ("candidate", "source-located", "content-verified", "disabled")
DATED, ANNOUNCED = r"^\d{4}[-/.年]\d{1,2}[-/.月]\d{1,2}日?\s*", r"^(?:研究)?(?:理论|模型)(?:介绍|集锦)?\s*[|｜丨:：·—-]*\s*"
EDGES = r"^[ |｜丨:：·—-]+|[ |｜丨:：·—-]+$"
THEORY = r"(?i)([A-Za-z][A-Za-z0-9\- '’]{2,80}(?:theory|model|framework)|[一-鿿A-Za-z0-9·—\-]{2,50}(?:理论|模型|框架|视角))"
#: What keeps a paragraph on the distribution of research from being idle (fixed pattern).
FOLLOWS = "理论|解释|推断|识别|外部效度|决策|后果|边界|机制"
SECTION_SHARES = {"研究范围与演进": 0.15, "理论与机制": 0.25, "多源线索与边界": 0.25, "方法与情境": 0.15, "争议、空白与议程": 0.20}


def some(c: Column | str) -> Column:
    """Whether a text, list or value holds anything."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.isNotNull() & ~F.trim(c.cast("string")).isin("", "[]", "{}"), F.lit(False))


# which records may be written from


def graded(records: DataFrame) -> DataFrame:
    """``records`` with publication_type, tier, peer_review and tier_rank."""
    r = records.withColumn("publication_type", publication_type(F.col("type"), F.col("title")))
    retracted = F.col("retracted") if "retracted" in records.columns else F.lit(False)
    r = r.withColumn("_t", evidence_tier(F.col("publication_type"), F.col("title"), F.coalesce(retracted, F.lit(False)), F.lit(False)))
    return r.select("*", F.col("_t.tier").alias("tier"), F.col("_t.peer_review").alias("peer_review"), tier_rank(F.col("_t.tier")).alias("tier_rank")).drop("_t")


def writing_eligible(records: DataFrame, screenings: DataFrame, planned: DataFrame) -> DataFrame:
    """Graded records that prose may cite: none of tier D, and once every planned record is screened only those screened as relevant.

    ``screenings`` (record_id, host_review_status, relevance); ``planned`` (record_id).
    """
    good = records.where("tier <> 'D'")
    done = screenings.where("host_review_status = 'completed'").select("record_id", F.lower(F.coalesce("relevance", F.lit(""))).alias("relevance")).groupBy("record_id").agg(F.max("relevance").alias("relevance"))
    open_ = planned.select("record_id").distinct().join(done, "record_id", "left_anti").agg(F.count("*").alias("open")).crossJoin(done.agg(F.count("*").alias("done")))
    relevant = done.where((F.col("relevance") != "") & ~F.col("relevance").rlike(BLOCKED)).select("record_id", F.lit(True).alias("_relevant"))
    out = good.join(relevant, "record_id", "left").crossJoin(F.broadcast(open_))
    return out.where("done = 0 or open > 0 or _relevant").drop("_relevant", "open", "done")


def best_fulltexts(records: DataFrame, files: DataFrame) -> DataFrame:
    """(record_id, path): the text file (path, stem) whose name is in the title of a record, or holds its first 30 letters; the longest name, then the path.

    A name is looked for by its first eight letters where a title has them, so titles and names are joined on
    equal runs of letters and never all with all. Equal titles and equal names are looked for once, and first
    letters that many have are dealt out, more widely where the session has more partitions.
    """
    run, head = 8, 30
    spread = 1 + int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16
    # both are read several times; read from tables, the ways below are tasks of their own
    titled = hold(records.select("record_id", normalize_title(F.col("title")).alias("t")).where("t <> ''"))
    r = hold(titled.select("t").distinct())
    # of equal names the last path counts; the best of several is that of the largest number, which is added up without sorting
    f = files.select("path", normalize_title(F.col("stem")).alias("s")).where("s <> ''").groupBy("s").agg(F.max("path").alias("path"))
    ranked = hold(numbered(f.withColumn("n", F.char_length("s")), "n", "path", "s").select("s", "path", "number"))
    f = ranked.select("s", "number")
    runs = lambda c: F.coalesce(runs_of(c, run), F.array(c))
    dealt = lambda c: F.pmod(F.xxhash64(c), F.lit(spread)).cast("int").alias("part")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("part")
    in_title = r.select("t", dealt("t"), F.explode(runs("t")).alias("k")).join(f.select("number", "s", everywhere, F.substring("s", 1, run).alias("k")), ["k", "part"]).where("contains(t, s)")
    # a name holds a title's first letters where one of its runs of that many is equal to them
    heads = f.where(F.char_length("s") >= head).select("number", F.explode(runs_of("s", head)).alias("h")).groupBy("h").agg(F.max("number").alias("number"))
    in_name = r.where(F.char_length("t") >= head).withColumn("h", F.substring("t", 1, head)).join(heads, "h")
    low = hold(r.where(F.char_length("t") < head))  # by its size this side is broadcast if any, not the pieces of names
    of_low = f.select("number", "s", dealt("s"), F.explode(runs("s")).alias("k")).hint("merge").join(low.select("t", everywhere, F.substring("t", 1, run).alias("k")), ["k", "part"]).where("contains(s, t)")
    # titles shorter than a run stand in names too, and names in titles; there are few of them
    pieces = F.flatten(F.array_compact(F.array(*[runs_of("s", k) for k in range(1, run)])))
    of_short = f.select("number", F.explode(pieces).alias("t")).join(low.where(F.char_length("t") < run), "t")
    short = f.where(F.char_length("s") < run).select("number", "s", F.substring("s", 1, 1).alias("k"))
    letters = r.select("t", F.explode(F.array_distinct(F.split("t", ""))).alias("k"))
    in_short = letters.join(short, "k").where("contains(t, s)")
    every = in_name.select("t", "number")
    for found in (in_title, of_low, in_short, of_short):
        every = every.unionByName(found.select("t", "number"))
    best = titled.join(every.groupBy("t").agg(F.max("number").alias("number")), "t").groupBy("record_id").agg(F.max("number").alias("number"))
    return best.join(ranked.select("number", "path"), "number").select("record_id", "path")


# evidence


def evidence_cards(records: DataFrame, fulltexts: DataFrame) -> DataFrame:
    """(record_id, evidence_level, card): what is known of a record, and the places that a reader fills."""
    r = records.join(fulltexts, "record_id", "left")
    level = F.when(F.col("path").isNotNull(), "fulltext").when(some("abstract"), "abstract").otherwise("metadata")
    lines = [
        F.concat(F.lit("# ["), F.col("record_id").cast("string"), F.lit("] "), F.coalesce("title", F.lit(""))), F.concat(F.lit("- evidence_level: "), level), F.concat(F.lit("- year: "), F.coalesce(F.col("year").cast("string"), F.lit(""))),
        F.concat(F.lit("- fulltext_path: "), F.coalesce("path", F.lit(""))), F.when(some("abstract"), F.concat(F.lit("\n"), "abstract")),
    ]
    return r.select("record_id", level.alias("evidence_level"), F.concat_ws("\n", *lines).alias("card"))


def topic_claims(topics: DataFrame, allowed: bool) -> DataFrame:
    """Claims that topics of a model (topic_id, documents, top_terms, representative_ids) allow; none where its gate is shut."""
    number = F.row_number().over(W.orderBy("topic_id"))  # a model has few topics
    text = F.concat(F.lit("topic "), F.col("topic_id").cast("string"), F.lit(": "), F.col("documents").cast("string"), F.lit(" documents; "), "top_terms")
    ids = F.filter(F.split("representative_ids", "; "), lambda x: x != "")
    return topics.where(F.lit(allowed)).select(F.concat(F.lit("C"), F.lpad(number.cast("string"), 4, "0")).alias("claim_id"), text.alias("claim"), F.lit("bibliometric").alias("claim_type"), F.lit("computed").alias("strength"), ids.alias("record_ids"))


def computed_claims(signals: list[tuple[str, DataFrame]], start: int = 2000, most: int = 20) -> DataFrame:
    """Claims from tables of signals (strength, value, supporting): the ``most`` strongest of each that name records, numbered after ``start``.

    Equal ones are ordered by value and then by the records they name.
    """
    rows = None
    for i, (kind, t) in enumerate(signals):
        top = t.select(F.lit(i).alias("i"), F.lit(kind).alias("kind"), F.col("strength").cast("double").alias("s"), F.col("value").cast("string").alias("value"), F.array_distinct(F.regexp_extract_all("supporting", F.lit("(R[0-9a-f]{14})"), F.lit(1))).alias("record_ids"))
        top = top.orderBy(F.desc("s"), "value", "record_ids").limit(most)
        rows = top if rows is None else rows.unionByName(top)
    number = start + F.row_number().over(W.orderBy("i", F.desc("s"), "value", "record_ids"))  # at most ``most`` rows of each kind
    r = rows.where(F.size("record_ids") > 0)
    return r.select(F.concat(F.lit("C"), F.lpad(number.cast("string"), 4, "0")).alias("claim_id"), F.concat_ws(": ", "kind", "value").alias("claim"), F.lit("bibliometric").alias("claim_type"), F.lit("computed").alias("strength"), "record_ids")


def citation_quotas(minimum: int, shares: dict[str, float] = SECTION_SHARES, least: int = 3) -> dict[str, int]:
    """Citations that each section needs: its share of the minimum, three at least."""
    import math

    return {k: max(least, math.ceil(minimum * v)) for k, v in shares.items()}


def build_evidence(records: DataFrame, supplement: DataFrame, fulltexts: DataFrame, topics: DataFrame, allowed: bool, signals: list[tuple[str, DataFrame]], kept: DataFrame) -> dict[str, DataFrame]:
    """The tables that writing starts from: graded records, cards, appraisals, and the ledger of topic, kept and computed claims.

    Records of ``supplement`` count for writing and are no part of the corpus; ``kept`` are claims of earlier ledgers
    (claim_id, claim, claim_type, strength, record_ids).
    """
    every = records.withColumn("in_corpus", F.lit(True)).unionByName(supplement.join(records.select("record_id"), "record_id", "left_anti").withColumn("in_corpus", F.lit(False)), allowMissingColumns=True)
    own = topic_claims(topics, allowed)
    old = kept.where("claim_type in ('abstract', 'fulltext', 'metadata')").join(own.select("claim_id"), "claim_id", "left_anti").select(*own.columns)
    ledger = own.unionByName(old)
    if signals:
        ledger = ledger.unionByName(computed_claims(signals))
    scope = F.when(F.col("claim_type").isin("fulltext", "abstract"), "direct").otherwise("computed-or-host-synthesis")
    return {"records": graded(every), "cards": evidence_cards(every, fulltexts), "appraisals": quality(every), "ledger": ledger.select("*", scope.alias("evidence_scope"), F.lit("pending").alias("support_check"))}


def repeated_dois(records: DataFrame, least: float = 0.9) -> DataFrame:
    """(a, b, severity): pairs of records of one DOI; an error if their titles are alike, else a warning.

    Each record is paired with the first of its DOI, so that a DOI of many records costs a row for each.
    """
    r = records.where(some("doi")).select("record_id", F.lower("doi").alias("doi"), "title")
    first = r.groupBy("doi").agg(F.min(F.struct(F.col("record_id").alias("a"), F.col("title").alias("ta"))).alias("x")).select("doi", "x.*")
    pairs = r.join(first, "doi").where("record_id <> a").select("a", F.col("record_id").alias("b"), "ta", F.col("title").alias("tb"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            alike = [bool(x) and bool(y) and ratio(x, y) >= least for x, y in zip(map(squeezed, pdf["ta"]), map(squeezed, pdf["tb"]), strict=True)]
            yield pdf[["a", "b"]].assign(severity=["error" if x else "warning" for x in alike])

    kind = records.schema["record_id"].dataType.simpleString()
    return pairs.mapInPandas(run, f"a {kind}, b {kind}, severity string")


def claim_violations(ledger: DataFrame, records: DataFrame, used: DataFrame, gates: dict[str, bool]) -> DataFrame:
    """(rule, id): what is wrong with claims (claim_id, claim_type, direction, strength, support_check, record_ids, anchors).

    ``records`` (record_id, tier) are all that may be cited, ``used`` (claim_id) the claims that drafts name, and ``gates`` tells of
    each marker in an anchor whether its module's results may be written from.
    """
    at = ledger.select("claim_id", "strength", "direction", F.explode("record_ids").alias("record_id")).join(records.select("record_id", "tier"), "record_id", "left")
    tiers = at.groupBy("claim_id", "strength", "direction").agg(F.collect_set(F.coalesce("tier", F.lit("D"))).alias("tiers"), F.countDistinct("record_id").alias("n"))
    named = tiers.join(used.select("claim_id").distinct(), "claim_id", "left_semi")
    key = F.col("claim_id").cast("string").alias("id")
    anchors = F.concat_ws(" ", "anchors")
    rules = {
        "unknown-record": at.where("tier is null").select(key).distinct(), "fulltext-without-anchor": ledger.where((F.col("claim_type") == "fulltext") & ~anchors.rlike(ANCHOR)).select(key), "unsupported": ledger.where("support_check = 'unsupported'").select(key),
        "high-strength-under-three-records": ledger.join(tiers.select("claim_id", "n"), "claim_id", "left").where("strength = 'high' and coalesce(n, 0) < 3").select(key),
        "strong-without-tier-a": named.where(F.col("strength").isin(*STRONG) & ~F.array_contains("tiers", "A")).select(key), "tier-c-only": named.where(F.col("tiers") == F.array(F.lit("C"))).select(key),
        "tier-d-in-support": named.where(F.array_contains("tiers", "D") & ~F.coalesce("direction", F.lit("")).isin(*ADVERSE)).select(key),
    }
    for marker, allowed in gates.items():
        if not allowed:
            rules[f"gate-shut-{marker}"] = ledger.where(F.contains(anchors, F.lit(marker))).select(key)
    return violations(rules)


def corpus_violations(records: DataFrame) -> DataFrame:
    """(rule, id): an empty corpus, ids that repeat, likely duplicates of one DOI, and retracted works."""
    empty = records.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("corpus").alias("id"))
    twice = records.groupBy("record_id").count().where("count > 1").select(F.col("record_id").cast("string").alias("id"))
    dois = repeated_dois(records).where("severity = 'error'").select(F.concat_ws(" ", F.col("a").cast("string"), F.col("b").cast("string")).alias("id"))
    rules = {"empty-corpus": empty, "record-id-not-unique": twice, "repeated-doi": dois}
    if "retracted" in records.columns:
        rules["retracted"] = records.where("retracted").select(F.col("record_id").cast("string").alias("id"))
    return violations(rules)


def status(stages: dict[str, DataFrame], field: str = "status") -> DataFrame:
    """(stage, status, n): how many rows of each stage's table have each status."""
    out = None
    for name, t in stages.items():
        n = t.groupBy(F.coalesce(F.col(field).cast("string"), F.lit("none")).alias("status")).agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "status", "n")
        out = n if out is None else out.unionByName(n)
    return out


# extractions


def matrices(extractions: DataFrame) -> dict[str, DataFrame]:
    """The theories, relations, methods and adverse findings of completed extractions, each as a table."""
    e = extractions.where("host_review_status = 'completed'")
    relations = e.select("record_id", F.explode("relations").alias("r"), "evidence_level", "design").select("record_id", "r.*", "evidence_level", "design")
    return {
        "theories": e.select("record_id", F.explode("theories").alias("theory"), "evidence_level"), "relations": relations, "methods": e.select("record_id", "design", F.array_join("contexts", "; ").alias("contexts"), F.array_join("methods", "; ").alias("methods")),
        "adverse": relations.where(F.col("status").isin(*ADVERSE_STATUSES)),
    }


def extraction_violations(extractions: DataFrame, records: DataFrame) -> DataFrame:
    """(rule, id) of completed extractions: unknown records, anchors that do not fit the level, relations without one, cause where the design has none."""
    e = extractions.where("host_review_status = 'completed'")
    key = F.col("record_id").cast("string").alias("id")
    anchored = F.concat_ws(" ", "anchors").rlike(ANCHOR)
    r = e.select("record_id", F.lower(F.coalesce("design", F.lit("unclear"))).alias("design"), F.explode("relations").alias("r"))
    words = F.concat_ws(" ", "r.subject", "r.predicate", "r.object")
    return violations({
        "unknown-record": e.join(records.select("record_id"), "record_id", "left_anti").select(key), "fulltext-without-anchor": e.where((F.col("evidence_level") == "fulltext") & ~anchored).select(key),
        "abstract-with-fulltext-anchor": e.where((F.col("evidence_level") == "abstract") & anchored).select(key), "relation-without-anchor": r.where(~some("r.anchor")).select(key).distinct(),
        "cause-beyond-design": r.where(F.col("design").isin(*NONCAUSAL) & words.rlike(CAUSE)).select(key).distinct(),
    })


def claim_group_violations(groups: DataFrame) -> DataFrame:
    """(rule, id) of grouped claims (claim, support_check, claim_status, studies)."""
    key = F.col("claim").alias("id")
    strong = F.col("claim_status") == "strong"
    return violations({"unsupported": groups.where("support_check = 'unsupported'").select(key), "strong-under-three-studies": groups.where(strong & (F.col("studies") < 3)).select(key), "strong-on-partial-support": groups.where(strong & (F.col("support_check") == "partial")).select(key)})


def open_reconciliations(groups: DataFrame, done: DataFrame) -> DataFrame:
    """(claim, reasons): grouped claims that a second reader settles, without those (claim) that are done."""
    adverse = (F.size("statuses") > 1) | F.arrays_overlap("statuses", F.array(*map(F.lit, ADVERSE_STATUSES)))
    many = F.col("studies") >= 3
    reasons = {"direction-or-significance-conflict": adverse, "support-pending-high-impact": many & F.coalesce("support_check", F.lit("pending")).isin("", "pending"), "high-impact-synthesis": many}
    r = groups.select("claim", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in reasons.items()])).alias("reasons"))
    return r.where(F.size("reasons") > 0).join(done.select("claim"), "claim", "left_anti")


# gaps and designs


def prepare_gaps(candidates: DataFrame, adverse: DataFrame, ledger: DataFrame) -> DataFrame:
    """(gap_id, title, source, documents, failure_evidence): gaps that the counts hint at and one for adverse findings, without those the ledger (gap_id) has."""
    c = candidates.select("gap_id", F.concat_ws(" ", F.lit("topic"), F.col("topic_id").cast("string")).alias("title"), F.lit("bibliometric").alias("source"), F.col("documents").cast("long").alias("documents"), F.array().cast("array<string>").alias("failure_evidence"))
    a = adverse.agg(F.array_sort(F.collect_set(F.col("record_id").cast("string"))).alias("failure_evidence")).where(F.size("failure_evidence") > 0)
    a = a.select(F.lit("GS001").alias("gap_id"), F.lit("adverse findings").alias("title"), F.lit("semantic").alias("source"), F.size("failure_evidence").cast("long").alias("documents"), "failure_evidence")
    return c.unionByName(a).join(ledger.select("gap_id"), "gap_id", "left_anti")


def gap_report(gaps: DataFrame) -> DataFrame:
    """One row: how many gaps are validated or opportunities, by level, and the state that follows."""
    g = normalize_gaps(gaps)
    n = g.agg(F.count("*").alias("gaps"), F.count_if((F.col("status") == "validated") & F.col("level").isin("A", "B")).alias("validated"), F.count_if(F.col("level") == "C").alias("opportunities"))
    return n.select("*", F.when(F.col("validated") > 0, "validated").otherwise("opportunity-only").alias("state"))


def gap_violations(gaps: DataFrame, records: DataFrame) -> DataFrame:
    """(rule, id): gaps whose evidence (failure_evidence, an array of record ids) names unknown records."""
    each = gaps.select("gap_id", F.explode("failure_evidence").alias("record_id")).where(F.col("record_id").rlike("^R[0-9a-f]{14}$"))
    return violations({"unknown-record": each.join(records.select("record_id"), "record_id", "left_anti").select(F.col("gap_id").alias("id")).distinct()})


def unearned_gaps(drafts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rule, excerpt): paragraphs that make a gap of how research is distributed, or call it fragmented, without saying what follows."""
    p = drafts.select(key, F.explode(F.split(text, r"\n\s*\n")).alias("p"))
    weak = F.col("p").rlike(WEAK_GAP) & ~F.col("p").rlike(FOLLOWS)
    loose = F.col("p").rlike(FRAGMENT_GAP) & ~F.col("p").rlike(DIAGNOSED)
    found = F.array_compact(F.array(F.when(weak, F.lit("distribution-without-consequence")), F.when(loose, F.lit("fragmentation-without-diagnosis"))))
    return p.select(key, F.explode(found).alias("rule"), F.substring(F.trim("p"), 1, 60).alias("excerpt"))


def recommend_designs(gaps: DataFrame, methods: DataFrame, mentions: DataFrame, most: int = 4) -> DataFrame:
    """(gap_id, method_id, role, place, overlap, corpus_mentions): the methods whose goals fit those of a gap best.

    ``gaps`` (gap_id, status, failure_type, inferential_goals, research_questions): the validated ones, or the opportunities where none is. ``methods``
    (method_id, goals, names) is a short catalogue; ``mentions`` (method, mentions) tells how often the corpus names a method.
    """
    v = gaps.agg(F.count_if(F.col("status") == "validated").alias("v"))
    chosen = gaps.crossJoin(F.broadcast(v)).where((F.col("status") == "validated") | ((F.col("v") == 0) & (F.col("status") == "opportunity")))
    q = chosen.select(F.col("gap_id").alias("question_id"), gap_goals(F.col("failure_type"), F.col("inferential_goals")).alias("goals"))
    top = overlap_top(q, methods.select("method_id", "goals"), most)
    n = methods.select("method_id", F.explode("names").alias("name")).join(mentions, F.contains(F.lower("method"), F.lower("name"))).dropDuplicates(["method_id", "method"]).groupBy("method_id").agg(F.sum("mentions").alias("corpus_mentions"))
    role = F.when(F.col("place") == 1, "primary-candidate").otherwise("alternative-or-robustness")
    return top.join(n, "method_id", "left").select(F.col("question_id").alias("gap_id"), "method_id", role.alias("role"), "place", "overlap", F.coalesce("corpus_mentions", F.lit(0)).cast("long").alias("corpus_mentions"))


def design_violations(recommendations: DataFrame, methods: DataFrame, gaps: DataFrame) -> DataFrame:
    """(rule, id): recommendations (gap_id, method_id, goals) of unknown or unfit methods, and gaps without questions, design needs or a method."""
    r = recommendations.join(methods.select("method_id", F.col("goals").alias("_goals")), "method_id", "left")
    open_ = gaps.where("status in ('validated', 'opportunity')")
    key = F.col("gap_id").alias("id")
    return violations({
        "unknown-method": r.where("_goals is null").select(F.col("method_id").alias("id")).distinct(), "unfit-method": r.where(F.col("_goals").isNotNull() & ~F.arrays_overlap("goals", "_goals")).select(F.col("method_id").alias("id")).distinct(),
        "gap-without-question": open_.where(~some("research_questions")).select(key), "gap-without-design-needs": open_.where(~some("design_requirements")).select(key), "gap-without-method": open_.join(recommendations.select("gap_id").distinct(), "gap_id", "left_anti").select(key),
    })


# theories


def theory_name(stem: Column, parent: Column, title: Column, text: Column) -> Column:
    """The first of folder (of an index page), page title, file name and first lines that names a theory, model or framework; else the first that is not empty."""
    lines = F.slice(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.regexp_replace(x, r"^[# *\t]+|[# *\t]+$", "")), lambda x: x != ""), 1, 12)
    given = F.concat(F.array(F.when(F.lower(stem) == "index", parent).otherwise(""), F.coalesce(title, F.lit("")), stem), lines)

    def tidy(v: Column) -> Column:
        v = F.trim(F.regexp_replace(v, r"\s+", " "))
        for pattern in (DATED, ANNOUNCED, EDGES):
            v = F.regexp_replace(v, pattern, "")
        return v

    names = F.filter(F.transform(given, tidy), lambda v: (v != "") & (F.lower(v) != "index"))
    found = F.transform(names, lambda v: F.regexp_extract(v, THEORY, 1))
    first = F.get(F.filter(found, lambda v: v != ""), F.lit(0))
    return F.coalesce(F.trim(first), F.substring(F.get(names, F.lit(0)), 1, 120), F.lit("Unnamed theory candidate"))


def theory_id(name: Column) -> Column:
    return F.concat(F.lit("T"), F.substring(F.sha1(normalize_title(name)), 1, 14))


def merge_cards(old: DataFrame, new: DataFrame, lists: list[str], scalars: list[str], key: str = "theory_id") -> DataFrame:
    """Cards of both tables, one for each key: lists are joined in order without repeats, scalars filled where absent."""
    a, b = old.select(key, *[F.col(c).alias(f"_o{c}") for c in [*lists, *scalars]]), new.select(key, *[F.col(c).alias(f"_n{c}") for c in [*lists, *scalars]])
    both = a.join(b, key, "full")
    none = F.array().cast("array<string>")
    listed = [F.array_distinct(F.concat(F.coalesce(f"_o{c}", none), F.coalesce(f"_n{c}", none))).alias(c) for c in lists]
    return both.select(key, *listed, *[F.when(some(f"_o{c}"), F.col(f"_o{c}")).otherwise(F.col(f"_n{c}")).alias(c) for c in scalars])


def advance_cards(cards: DataFrame, confirmed: DataFrame) -> DataFrame:
    """``cards`` with their next state: candidates that are complete have their source located, confirmed ones (theory_id) of those are verified.

    Complete is a card that is reviewed and has constructs, mechanisms, boundaries, a source and notes. Cards that are disabled or
    verified stay as they are.
    """
    c = cards.join(confirmed.select("theory_id").distinct().withColumn("_yes", F.lit(True)), "theory_id", "left")
    sourced = some("foundational_sources") | some("review_sources")
    whole = (F.col("host_review_status") == "completed") & some("constructs") & some("mechanisms") & some("boundary_conditions") & sourced & some("verification_notes")
    state = F.col("verification_status")
    new = F.when(state.isin("disabled", "content-verified"), state).when((state == "source-located") & F.coalesce("_yes", F.lit(False)), "content-verified").when(whole, "source-located").otherwise(state)
    return c.withColumn("verification_status", new).select(*cards.columns)


def card_violations(cards: DataFrame) -> DataFrame:
    """(rule, id): cards of an unknown state, and verified ones without an authoritative source."""
    key = F.col("theory_id").alias("id")
    bare = ~(some("foundational_sources") | some("review_sources"))
    return violations({"unknown-state": cards.where(~F.coalesce("verification_status", F.lit("")).isin(*THEORY_STATES)).select(key), "verified-without-source": cards.where((F.col("verification_status") == "content-verified") & bare).select(key)})


def adopted_theories(fits: DataFrame) -> DataFrame:
    """``fits`` decided for adoption, with ``adopted``: whether the source is verified and rationale, assumptions and boundaries fit; others are to be rewritten."""
    verified = (F.col("verification_status") == "content-verified") | F.coalesce("source_verified", F.lit(False))
    fit = F.forall(F.array("fit_rationale", "assumption_fit", "boundary_fit"), lambda x: ~F.lower(F.coalesce(x, F.lit(""))).isin("", "unchecked", "mismatch"))
    return fits.where("decision = 'adopt'").withColumn("adopted", verified & fit)


def competing_theories(fits: DataFrame) -> DataFrame:
    """(theory_id, name, competing_theory, explanatory_target, discriminating_prediction): one row for each rival."""
    return fits.select("theory_id", "name", F.explode("competing_theories").alias("competing_theory"), "explanatory_target", "discriminating_prediction")


def expand_evidence(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates whose inclusion is decided (record_id, decision, role, directness, topics, reason), with role and directness or their defaults."""
    d = decisions.where("decision = 'include'").dropDuplicates(["record_id"])
    default = lambda c, v: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(v))
    more = d.select("record_id", default("role", "adjacent-mechanism").alias("writing_evidence_role"), default("directness", "adjacent").alias("directness"), F.coalesce("topics", F.array().cast("array<string>")).alias("writing_evidence_topics"), F.coalesce("reason", F.lit("")).alias("writing_evidence_reason"))
    return candidates.join(more, "record_id")


def extraction_tasks(records: DataFrame, done: DataFrame) -> DataFrame:
    """(record_id, source_hash, design): records to be read, without those of which an extraction of the same text (record_id, source_hash) is there."""
    from ..functions.records import content_hash

    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("abstract", F.lit("")))
    r = records.select("record_id", content_hash(text).alias("source_hash"), study_design(text).alias("design"))
    return r.join(done.select("record_id", "source_hash"), ["record_id", "source_hash"], "left_anti")
