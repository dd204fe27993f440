"""Column functions and rules over drafts, extracted texts and gap entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import DOI, normalize_title

#: Signals in sentences (fixed values).
SIGNALS = {
    "factual": r"(?i)研究|文献|证据|语料|发现|表明|显示|影响|导致|机制|中介|调节|相关|增长|下降|stud(?:y|ies)|evidence|findings?|affects?|causes?|associated|mediates?|moderates?",
    "causal": r"(?i)导致|引起|决定|驱动|causes?|leads? to|determines?|drives?",
    "opposing": r"(?i)然而|但是?|相反|反向|负向|不显著|矛盾|分歧|however|in contrast|negative|nonsignificant|non-significant|mixed findings|contradict",
    "contribution": r"(?i)贡献|创新|填补|拓展|扩展|contribut|novelty|advance",
    "evidence": r"(?i)(?:一些|多项|既有|现有|相关|过去)?(?:研究|文献|语料|证据)(?:表明|显示|发现|指出|提示|呈现|报告|认为)|(?:一些|多项|既有|现有)研究",
}
#: Kinds of failure by the level of a gap (fixed values).
LEVELS = {
    "A": ("assumption-failure", "competing-explanations", "contradiction", "mechanism-missing", "boundary-failure", "construct-mismatch", "phenomenon-vocabulary"),
    "B": ("measurement", "causal-identification", "bias", "imprecision", "inconsistency", "sample-dependence", "external-validity", "intention-behavior"),
}
#: What a gap of a kind asks for (fixed values).
GOALS = {
    "measurement": ["measurement"], "causal-identification": ["causal"], "mechanism-missing": ["explanation", "mechanism"],
    "competing-explanations": ["explanation", "mechanism"], "contradiction": ["explanation", "heterogeneity"],
    "inconsistency": ["synthesis", "heterogeneity"], "boundary-failure": ["heterogeneity"], "external-validity": ["heterogeneity"],
    "intention-behavior": ["longitudinal", "causal"], "construct-mismatch": ["measurement", "qualitative"],
}


#: Words of a gap that is no more than a distribution, a fragmentation or an unused method, and of a diagnosis (fixed patterns).
WEAK_GAP = r"(?i)研究较少|关注不足|尚未研究|国内.{0,8}(?:缺乏|不足)|文献不足|未使用.{0,12}方法|understudied|few studies|not been studied"
FRAGMENT_GAP = r"(?i)研究碎片化|文献碎片化|未形成统一框架|没有统一框架|fragmented|no unified framework"
METHOD_GAP = r"方法缺口|未使用.{0,12}方法"
DIAGNOSED = r"假设|构念|机制|边界|设计"


def signal(text: Column, name: str) -> Column:
    return F.coalesce(text.rlike(SIGNALS[name]), F.lit(False))


def atomic_units(sentence: Column) -> Column:
    """Parts of a sentence up to each semicolon that stands in no round or square bracket, trimmed, without empty ones."""
    start = F.struct(F.lit(0).alias("r"), F.lit(0).alias("s"), F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, c: Column) -> Column:
        r = F.when(c.isin("(", "（"), a["r"] + 1).when(c.isin(")", "）"), F.greatest(F.lit(0), a["r"] - 1)).otherwise(a["r"])
        s = F.when(c == "[", a["s"] + 1).when(c == "]", F.greatest(F.lit(0), a["s"] - 1)).otherwise(a["s"])
        ends = c.isin(";", "；") & (a["r"] == 0) & (a["s"] == 0)
        text = F.concat(a["now"], c)
        return F.struct(r.alias("r"), s.alias("s"), F.when(ends, F.lit("")).otherwise(text).alias("now"), F.when(ends, F.array_append(a["out"], F.trim(text))).otherwise(a["out"]).alias("out"))

    parts = F.aggregate(F.split(sentence, ""), start, step, lambda a: F.array_append(a["out"], F.trim(a["now"])))
    return F.filter(parts, lambda p: p != "")


def paragraphs(body: DataFrame, key: str, text: str) -> DataFrame:
    """(key, paragraph, text): blocks between blank lines, counted from 1, without headings and empty blocks."""
    p = body.select(key, F.posexplode(F.split(text, r"\n\s*\n")).alias("i", "text"))
    return p.where("trim(text) <> '' and not startswith(ltrim(text), '#')").select(key, (F.col("i") + 1).cast("long").alias("paragraph"), F.trim("text").alias("text"))


def uncited_claims(body: DataFrame, key: str, text: str) -> DataFrame:
    """Sentences that call on evidence without a year in brackets or the id of a record or claim."""
    s = paragraphs(body, key, text).select(key, "paragraph", F.posexplode(F.split("text", r"(?<=[。！？!?])")).alias("place", "sentence"))
    seen = F.col("sentence").rlike(r"[\(（][^\n\)）]*\b(?:19|20)\d{2}[a-z]?[^\n\)）]*[\)）]") | F.col("sentence").rlike(r"\bR[0-9a-f]{14}\b|\bC\d{4}\b")
    return s.where((F.trim("sentence") != "") & signal(F.col("sentence"), "evidence") & ~seen).select(key, "paragraph", F.col("place").cast("long").alias("place"), "sentence")


def reference_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, raw, doi, year): lines of 20 characters or more after the heading of the references."""
    head = r"(?im)^#{0,3}\s*(?:\[[^]]+\]\s*)?(?:references|bibliography|参考文献)\s*$"
    tail = F.when(F.col(text).rlike(head), F.get(F.split(text, head, 2), F.lit(1)))
    raw = F.trim(F.regexp_replace(F.col("line"), r"^(?:<!--.*?-->|#+|\[?\d+\]?[.)]?\s*)", ""))
    rows = texts.select(key, F.explode(F.split(tail, r"\r?\n")).alias("line")).select(key, raw.alias("raw")).where("char_length(raw) >= 20")
    return rows.select(key, "raw", F.regexp_replace(F.regexp_extract("raw", DOI, 0), r"[.,)]+$", "").alias("doi"), F.regexp_extract("raw", r"(?:19|20)\d{2}", 0).try_cast("int").alias("year"))


def gap_level(failure: Column) -> Column:
    return F.when(failure.isin(*LEVELS["A"]), "A").when(failure.isin(*LEVELS["B"]), "B").otherwise("C")


def gap_goals(failure: Column, own: Column) -> Column:
    """The goals that a gap names, else those of its kind."""
    table = F.create_map(*[x for k, v in GOALS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.when(F.size(own) > 0, own).otherwise(F.coalesce(F.try_element_at(table, failure), F.array(F.lit("description"))))


def normalize_gaps(gaps: DataFrame) -> DataFrame:
    """(gap_id, level, status, notes) of gap entries.

    A gap of level A or B holds if all parts of its diagnosis are there and what it compares has been checked; else it becomes an
    opportunity of level C, and the notes say why.
    """
    parts = ["known_findings", "current_explanation", "failure_point", "failure_evidence", "knowledge_consequence", "repair_strategy", "research_questions", "design_requirements"]
    whole = F.lit(True)
    for c in parts:
        whole = whole & (F.coalesce(F.col(c), F.lit("")) != "")
    f = F.coalesce("failure_type", F.lit("distribution-only"))
    text = F.concat_ws(" ", "title", "failure_point", "knowledge_consequence")
    method = (f == "underused-method") | text.rlike(METHOD_GAP)
    high = gap_level(f) != "C"
    apart = f.isin("contradiction", "inconsistency") & ~F.coalesce(F.col("comparable"), F.lit(False))
    weak = text.rlike(WEAK_GAP) & (F.coalesce("knowledge_consequence", F.lit("")) == "")
    pieces = text.rlike(FRAGMENT_GAP) & ~F.coalesce("failure_point", F.lit("")).rlike(DIAGNOSED)
    cause = (f == "mechanism-missing") & ~F.coalesce(F.col("mechanism_audited"), F.lit(False))
    edge = f.isin("boundary-failure", "external-validity") & (F.coalesce("boundary_assumption", F.lit("")) == "")
    why = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in (("underused-method", method), ("not-comparable", high & whole & apart), ("incomplete-diagnosis", high & ~whole & ~method), ("distribution-signal", weak), ("fragmentation", pieces), ("mechanism-not-audited", cause), ("no-boundary-assumption", edge))]))
    g = gaps.withColumn("_why", why)
    down = F.size("_why") > 0
    return g.select("gap_id", F.when(down, "C").otherwise(gap_level(f)).alias("level"), F.when(down, "opportunity").when(high, "validated").otherwise(F.coalesce("status", F.lit("opportunity"))).alias("status"), F.array_join("_why", ",").alias("notes"))


def runs_of(c: str, size: int) -> Column:
    """The distinct runs of ``size`` characters in a text; null for a shorter one."""
    n = F.char_length(c)
    return F.when(n >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substring(F.col(c), i, F.lit(size)))))


def link_fulltexts(texts: DataFrame, records: DataFrame) -> DataFrame:
    """(file, record_id): texts (file, stem, text) that name exactly one record, by DOI, by title, or by a telling file name.

    Both sides are met by keys: DOIs found in the first 20,000 characters, the first 20 characters of titles
    looked up among all runs of that length, and file names.
    """
    t = texts.select("file", normalize_title(F.col("stem")).alias("stem"), F.lower(F.substring("text", 1, 20_000)).alias("low")).withColumn("key", normalize_title(F.col("low")))
    r = records.select("record_id", F.lower("doi").alias("doi"), normalize_title(F.col("title")).alias("title"))
    by_doi = t.select("file", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("low", F.lit(DOI), F.lit(0)), lambda x: F.regexp_replace(x, r"[. ,;)]+$", "")))).alias("doi")).join(r.where("doi <> ''"), "doi").select("file", "record_id")
    long = r.where("char_length(title) >= 20").withColumn("run", F.substring("title", 1, 20))
    by_title = t.select("file", "key", F.explode(runs_of("key", 20)).alias("run")).join(long, "run").where(F.contains("key", F.substring("title", 1, 60))).select("file", "record_id")
    names = t.where("char_length(stem) >= 12").select("file", "stem")
    named = r.where("title <> ''").select("record_id", "title")
    # a name in a title, a title in a name, and a short title in a name
    in_title = names.withColumn("k", F.substring("stem", 1, 12)).join(named.select("record_id", "title", F.explode(runs_of("title", 12)).alias("k")), "k").where("contains(title, stem)")
    in_name = names.select("file", "stem", F.explode(runs_of("stem", 8)).alias("k")).join(named.withColumn("k", F.substring("title", 1, 8)).where("char_length(title) >= 8"), "k").where("contains(stem, title)")
    short = names.select("file", F.explode(F.flatten(F.array(*[runs_of("stem", k) for k in range(1, 8)]))).alias("title")).join(named.where("char_length(title) < 8"), "title")
    by_name = in_title.select("file", "record_id").unionByName(in_name.select("file", "record_id")).unionByName(short.select("file", "record_id"))
    one = by_doi.unionByName(by_title).unionByName(by_name).distinct().groupBy("file").agg(F.count("*").alias("n"), F.first("record_id").alias("record_id"))
    return one.where("n = 1").select("file", "record_id")


def exclusion_counts(records: DataFrame) -> DataFrame:
    """How many records each first reason took out."""
    return records.where("status <> 'included' and size(reasons) > 0").groupBy(F.get("reasons", F.lit(0)).alias("reason")).agg(F.count("*").alias("records"))


def stage_log(log: DataFrame, stage: str, records: DataFrame, at: str) -> DataFrame:
    """``log`` (place, stage, at, records) with one more stage: how many records there are at it."""
    place = log.agg((F.coalesce(F.max("place"), F.lit(0)) + 1).cast("long").alias("place"))
    row = place.crossJoin(records.agg(F.count("*").alias("records"))).select("place", F.lit(stage).alias("stage"), F.lit(at).alias("at"), "records")
    return log.unionByName(row)
