"""Kinds, tiers and designs of works, checks of claims, references for export, and pooled effects."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import hold
from .drafts import clean_reference

#: Names of publication types (fixed values).
TYPES = {
    "article": "journal-article", "journal article": "journal-article", "journal-article": "journal-article", "jour": "journal-article",
    "review": "review", "systematic review": "systematic-review", "meta-analysis": "meta-analysis",
    "dissertation": "thesis", "thesis": "thesis", "phd thesis": "thesis", "master thesis": "thesis",
    "book-chapter": "book-chapter", "book chapter": "book-chapter", "chapter": "book-chapter", "book": "book",
    "proceedings-article": "conference-paper", "conference paper": "conference-paper", "conference-paper": "conference-paper", "conference": "conference-paper",
    "preprint": "preprint", "posted-content": "preprint", "working paper": "working-paper",
    "report": "report", "editorial": "editorial", "paratext": "paratext", "other": "other",
}
#: Study designs by the first pattern that a title or abstract has (fixed values).
DESIGNS = [
    ("experiment", r"\bexperiment|randomi[sz]ed|laboratory|field experiment|实验"),
    ("qualitative", r"\binterview|focus group|ethnograph|qualitative|访谈|质性"),
    ("review", r"\breview|meta-analysis|systematic|综述|元分析"),
    ("longitudinal-observational", r"\blongitudinal|panel data|time series|experience sampling|daily diary|纵向|面板|日记"),
    ("computational", r"\bclickstream|digital trace|log data|machine learning|text mining|social network analysis|行为日志|文本挖掘"),
    ("observational", r"\bobservational|secondary data|archival|cross-sectional|观察性|二手数据"),
    ("survey", r"\bsurvey|questionnaire|respondent|问卷|调查"),
]
#: What an appraisal looks at, by design (fixed values).
DIMENSIONS = {
    "experiment": ["randomization", "manipulation_check", "attrition", "outcome_blinding"],
    "survey": ["construct_validity", "common_method_bias", "sampling_frame", "nonresponse"],
    "observational": ["temporal_order", "confounding_control", "selection_bias", "missing_data"],
    "longitudinal-observational": ["temporal_order", "attrition", "time_varying_confounding", "measurement_invariance"],
    "qualitative": ["sampling_rationale", "reflexivity", "triangulation", "negative_cases"],
    "review": ["search_transparency", "dual_screening", "risk_of_bias", "synthesis_fit"],
    "computational": ["data_provenance", "construct_operationalization", "holdout_validation", "algorithmic_bias"],
    "unclear": ["design_identification", "sampling", "measurement", "analysis_fit"],
}
SAMPLE = r"(?i)(?:n\s*=\s*\d+|\d+\s+(?:participants?|respondents?|consumers?)|[A-Z][A-Za-z]+\s+(?:dataset|panel))"
#: The same, with runs of letters and digits begun at their first one only (or where the last match ended), so that long runs do not cost their square.
SAMPLE_RUNS = r"(?i)(?:n\s*=\s*\d+|(?:(?<!\d)|\G)\d++\s+(?:participants?|respondents?|consumers?)|(?:(?<![A-Z])|\G)[A-Z][A-Z]++\s+(?:dataset|panel))"


def publication_type(kind: Column, title: Column) -> Column:
    """One name for each kind of publication; a title that says so makes a meta-analysis or systematic review."""
    raw = F.replace(F.lower(F.trim(F.coalesce(kind, F.lit("other")))), F.lit("_"), F.lit("-"))
    known = dict.fromkeys([*TYPES, *TYPES.values()])
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k in known for x in (k, TYPES.get(k, k))]), raw), F.lit("other"))
    low = F.lower(F.coalesce(title, F.lit("")))
    return F.when(low.rlike(r"\bmeta[- ]analysis\b"), "meta-analysis").when(low.rlike(r"\bsystematic review\b"), "systematic-review").otherwise(name)


def evidence_tier(ptype: Column, title: Column, retracted: Column, full_paper: Column, conference_primary: bool = False) -> Column:
    """(tier, peer_review, roles, reason): what a work of a kind can support, A first, in which roles a claim may use it, and why."""
    t = F.coalesce(title, F.lit(""))
    out = F.coalesce(retracted, F.lit(False)) | t.rlike(r"(?i)\bretracted\b") | t.rlike(r"(?i)\b(?:full issue|entire issue|table of contents)\b|整期|全期|目录") | ptype.isin("editorial", "paratext") | (F.trim(t) == "")
    s = lambda tier, review, reason, *roles: F.struct(F.lit(tier).alias("tier"), F.lit(review).alias("peer_review"), F.array(*map(F.lit, roles)).cast("array<string>").alias("roles"), F.lit(reason).alias("reason"))
    late = ("supplement", "unique-context", "counterevidence")
    return (
        F.when(out, s("D", "not-eligible", "retracted, a collection, or not identified"))
        .when(ptype == "journal-article", s("A", "peer-reviewed-assumed", "peer-reviewed journal", "empirical"))
        .when(ptype.isin("review", "systematic-review", "meta-analysis"), s("A", "peer-reviewed-assumed", "peer-reviewed journal", "synthesis"))
        .when(ptype.isin("book", "book-chapter"), s("A", "scholarly-source", "book: theory and history of concepts only", "theory", "concept-history"))
        .when((ptype == "conference-paper") & F.lit(conference_primary) & F.coalesce(full_paper, F.lit(False)), s("A", "peer-reviewed-explicit", "full paper in a conference-led field", "empirical", "emerging"))
        .when(ptype == "thesis", s("B", "examined", "thesis, conference paper or report", *late))
        .when(ptype.isin("conference-paper", "report"), s("B", "review-status-limited", "thesis, conference paper or report", *late))
        .when(ptype.isin("preprint", "working-paper"), s("C", "not-confirmed", "preprint or working paper", "exploratory", "emerging", "counterevidence"))
        .otherwise(s("D", "unknown", "kind or status unknown"))
    )


def tier_rank(tier: Column) -> Column:
    return F.when(tier == "A", 0).when(tier == "B", 1).when(tier == "C", 2).otherwise(3).cast("long")


def study_design(text: Column) -> Column:
    """The first of DESIGNS that a text has; a pattern is tried where the text holds the plain beginning of one of its branches."""

    def named(low: Column) -> Column:
        out = F.lit("unclear")
        for name, pattern in reversed(DESIGNS):
            plain = [F.contains(low, F.lit(x.replace(r"\b", "").split("[")[0])) for x in pattern.split("|")]
            out = F.when(reduce(lambda x, y: x | y, plain) & low.rlike(pattern), name).otherwise(out)
        return out

    return once(F.lower(text), named)


def quality(records: DataFrame, fulltext: Column | None = None) -> DataFrame:
    """Design, evidence level, what the abstract reports, whether its sample may be that of another record, and what an appraisal looks at.

    ``fulltext`` tells which records have a full text; without it none has. Texts are read in their rows; only what was found is shuffled.
    """
    full = F.lit(False) if fulltext is None else F.coalesce(fulltext, F.lit(False))
    looked_at = F.create_map(*[F.lit(x) for k, v in DIMENSIONS.items() for x in (k, "; ".join(v))])
    a = F.coalesce("abstract", F.lit(""))
    who = F.array_join(F.transform(F.slice(F.coalesce(F.col("authors"), F.array().cast("array<string>")), 1, 2), lambda x: F.lower(x)), ";")
    signed = lambda found: F.when(F.size(found) > 0, F.substring(F.sha2(F.concat(who, F.lit("|"), F.coalesce(F.col("year").cast("string"), F.lit("None")), F.lit("|"), F.array_join(found, "|")), 256), 1, 12)).otherwise("")
    sig = once(F.array_sort(F.transform(F.regexp_extract_all(a, F.lit(SAMPLE_RUNS), F.lit(0)), lambda x: F.lower(x))), signed)
    r = records.select(
        "record_id", study_design(F.concat_ws(" ", "title", "abstract")).alias("study_design"), F.when(full, "fulltext").when(a != "", "abstract").otherwise("metadata").alias("evidence_level"),
        a.rlike(r"(?i)\b(?:n\s*=|sample|participants?|respondents?|dataset)|样本|参与者").alias("reports_sample"), a.rlike(r"(?i)\bmethod|regression|sem\b|experiment|interview|survey|方法|实验|回归").alias("reports_method"),
        a.rlike(r"(?i)\blimitations?|局限").alias("reports_limitations"), sig.alias("sample_signature"), F.when(full, "requires-host-appraisal").otherwise("not-assessable-from-abstract").alias("risk_of_bias"),
    )
    r = hold(r)
    # most records name no sample: they share no signature, and are not brought together
    shared = r.where("sample_signature <> ''").groupBy("sample_signature").agg(F.count("*").alias("_records")).where("_records > 1")
    return r.join(shared, "sample_signature", "left").select(
        "record_id", "study_design", "evidence_level", "reports_sample", "reports_method", "reports_limitations", "sample_signature",
        F.when(F.col("_records").isNotNull(), "possible-overlap-needs-review").otherwise("unverified").alias("independent_sample_status"), "risk_of_bias", looked_at[F.col("study_design")].alias("appraisal_dimensions"),
    )


def missing_keys(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose key no row of ``parent`` has."""
    return child.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, side): ids that only one of two sets has."""
    a, b = left.select("id").distinct(), right.select("id").distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def replace_scope(ledger: DataFrame, new: DataFrame, scope: str) -> DataFrame:
    """``ledger`` with all rows of the scopes in ``new`` replaced by ``new``."""
    return ledger.join(new.select(scope).distinct(), scope, "left_anti").unionByName(new, allowMissingColumns=True)


def ris_escape(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " "))


def ris(title: Column, authors: Column, year: Column, venue: Column, doi: Column, abstract: Column, keywords: Column, kind: str = "JOUR") -> Column:
    """A record in RIS form, one tag a line, absent fields left out."""
    tag = lambda name, c: F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{name}  - "), ris_escape(c.cast("string"))))
    many = lambda name, a: F.when(F.size(a) > 0, F.array_join(F.transform(a, lambda x: F.concat(F.lit(f"{name}  - "), ris_escape(x))), "\n"))
    return F.concat_ws("\n", F.lit(f"TY  - {kind}"), tag("TI", title), many("AU", authors), tag("PY", year), tag("JO", venue), tag("DO", doi), tag("AB", abstract), many("KW", keywords), F.lit("ER  - "))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that it names more than once, computed once for a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def author_names(authors: Column) -> Column:
    """Names without repeats: none that differs from an earlier one by marks only, and no abbreviated one whose surname and first initial an earlier one has."""
    tidy = F.filter(F.transform(F.coalesce(authors, F.array().cast("array<string>")), lambda x: F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "), r"^[ ,;]+|[ ,;]+$", "")), lambda x: x != "")

    def read(name: Column) -> Column:
        return once(F.regexp_extract_all(name, F.lit("([A-Za-z]+)"), F.lit(1)), lambda words: told(name, words))

    def told(name: Column, words: Column) -> Column:
        n, comma = F.size(words), F.contains(name, F.lit(","))
        surname = F.lower(F.when(comma, F.trim(F.substring_index(name, ",", 1))).otherwise(F.coalesce(F.get(words, n - 1), name)))
        given = F.array_join(F.when(comma, F.slice(words, 2, F.greatest(n, F.lit(1)))).otherwise(F.slice(words, 1, F.greatest(n - 1, F.lit(0)))), "")
        short = name.rlike(r"^[A-Za-z.' -]+,?\s*[A-Za-z. -]{1,5}$")
        return F.struct(name.alias("name"), F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}_]+", "")).alias("plain"), F.concat(surname, F.lower(F.substring(given, 1, 1))).alias("short"), short.alias("is_short"))

    read_all = F.transform(tidy, read)
    none = F.array().cast("array<struct<name:string,plain:string,short:string,is_short:boolean>>")
    repeats = lambda kept, x: F.exists(kept, lambda k: (k["plain"] == x["plain"]) | (x["is_short"] & (k["short"] == x["short"])))
    kept = F.aggregate(read_all, none, lambda acc, x: F.when(repeats(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    return F.transform(kept, lambda k: k["name"])


def apa(authors: Column, year: Column, title: Column, venue: Column, doi: Column, volume: Column | None = None, issue: Column | None = None, pages: Column | None = None) -> Column:
    """A reference in APA form: up to 20 authors, or 19, an ellipsis and the last; venue with volume, issue and pages.

    Null and empty parts are left out, but for author, year and title, which have names for being absent.
    """

    def listed(a: Column) -> Column:
        n = F.size(a)
        few = F.when(n == 1, F.get(a, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(a, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(", & "), F.get(a, n - 1)))
        return F.when(n == 0, "Unknown author").when(n <= 20, few).otherwise(F.concat(F.array_join(F.slice(a, 1, 19), ", "), F.lit(", …, "), F.get(a, n - 1)))

    who = once(author_names(authors), listed)
    when = F.when(F.coalesce(year.cast("string"), F.lit("")).isin("", "0"), "n.d.").otherwise(year.cast("string"))
    text = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit(""))) if c is not None else F.lit("")
    ended = lambda c: F.regexp_replace(text(c), "[.。]+$", "")
    part = lambda c, before, after: F.when(text(c) != "", F.concat(F.lit(before), text(c), F.lit(after))).otherwise("")
    name = F.when(text(title) == "", "Untitled").otherwise(ended(title))
    published = F.when(ended(venue) != "", F.concat(ended(venue), part(volume, ", ", ""), part(issue, "(", ")"), part(pages, ", ", ""), F.lit(".")))
    link = F.when(text(doi) != "", F.concat(F.lit("https://doi.org/"), F.regexp_replace(text(doi), r"(?i)^https?://(?:dx\.)?doi\.org/", "")))
    return clean_reference(F.concat_ws(" ", F.concat(who, F.lit(".")), F.concat(F.lit("("), when, F.lit(").")), F.concat(name, F.lit(".")), published, link))


def csl(record_id: Column, title: Column, authors: Column, year: Column, venue: Column, doi: Column, kind: Column | None = None, **more: Column) -> Column:
    """A record as an item of CSL-JSON; ``more`` holds volume, issue, page, publisher, ISSN and ISBN where they are known. What is absent is empty."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("")) if c is not None else F.lit("")

    def person(name: Column) -> Column:
        comma, words = F.contains(name, F.lit(",")), F.split(name, r"\s+")
        n = F.size(words)
        family = F.when(comma, F.trim(F.substring_index(name, ",", 1))).otherwise(F.when(n > 1, F.get(words, n - 1)).otherwise(name))
        given = F.when(comma, F.trim(F.regexp_replace(name, "^[^,]*,", ""))).otherwise(F.array_join(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), " "))
        return F.struct(family.alias("family"), given.alias("given"))

    names = F.filter(F.transform(F.coalesce(authors, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    issued = F.when(F.coalesce(year, F.lit(0)) != 0, F.create_map(F.lit("date-parts"), F.array(F.array(year.cast("int"))))).otherwise(F.create_map().cast("map<string,array<array<int>>>"))
    form = F.when(text(kind).isin("", "article"), "article-journal").otherwise(text(kind))
    rest = [text(more.get(k)).alias(k) for k in ("volume", "issue", "page", "publisher")]
    return F.to_json(F.struct(record_id.cast("string").alias("id"), form.alias("type"), text(title).alias("title"), F.transform(names, person).alias("author"), issued.alias("issued"), text(venue).alias("container-title"), *rest, text(doi).alias("DOI"), *[text(more.get(k)).alias(k) for k in ("ISSN", "ISBN")]))


def working_scale(metric: Column, estimate: Column, se: Column, low: Column, high: Column, n: Column) -> Column:
    """(y, s): effect and standard error on the scale that is pooled; null where they cannot be had."""
    ratio = metric.isin("or", "rr")
    y = F.when(metric == "r", F.when(F.abs(estimate) < 1, F.atanh(estimate))).when(ratio, F.when(estimate > 0, F.log(estimate))).otherwise(estimate)
    span = F.when(ratio & (low > 0) & (high > 0), F.log(high) - F.log(low)).when((metric == "r") & (F.abs(low) < 1) & (F.abs(high) < 1), F.atanh(high) - F.atanh(low)).when(~ratio & (metric != "r"), high - low)
    by_n = F.when((metric == "r") & (n > 3), 1 / F.sqrt(n - 3))
    s = F.coalesce(F.when(se > 0, se), F.when(span > 0, span / (2 * 1.95996398454)), by_n)
    return F.when(y.isNotNull() & s.isNotNull(), F.struct(y.alias("y"), s.alias("s")))


def fixed_effect(effects: DataFrame, group: str) -> DataFrame:
    """Per group of (y, s): studies, pooled effect and its error by inverse variances, Q and I squared."""
    w = 1 / (F.col("s") * F.col("s"))
    g = effects.groupBy(group).agg(F.count("*").alias("studies"), F.sum(w).alias("sw"), F.sum(w * F.col("y")).alias("swy"), F.sum(w * F.col("y") * F.col("y")).alias("swyy"))
    q = F.greatest(F.lit(0.0), F.col("swyy") - F.col("swy") * F.col("swy") / F.col("sw"))
    return g.select(group, "studies", F.round(F.col("swy") / F.col("sw"), 6).alias("pooled"), F.round(1 / F.sqrt("sw"), 6).alias("standard_error"), F.round(q, 4).alias("q"), F.round(F.when(q > 0, F.greatest(F.lit(0.0), (q - F.col("studies") + 1) / q)).otherwise(0.0), 4).alias("i2"))


def leave_one_out(effects: DataFrame, group: str, key: str) -> DataFrame:
    """Per effect the pooled effect of its group without it: its own share taken off the group's sums."""
    w = 1 / (F.col("s") * F.col("s"))
    sums = effects.groupBy(F.col(group).alias("_group")).agg(F.sum(w).alias("_sw"), F.sum(w * F.col("y")).alias("_swy"))
    without = (F.col("_swy") - w * F.col("y")) / F.nullif(F.col("_sw") - w, F.lit(0.0))
    return effects.join(sums, F.col(group).eqNullSafe(F.col("_group"))).select(group, key, F.round(without, 6).alias("pooled_without"))


def violations(rules: dict[str, DataFrame]) -> DataFrame:
    """(rule, id): all rows of the rules' frames, each of which has a column id."""
    out = None
    for name, df in rules.items():
        one = df.select(F.lit(name).alias("rule"), F.col("id").cast("string").alias("id"))
        out = one if out is None else out.unionByName(one)
    return out
