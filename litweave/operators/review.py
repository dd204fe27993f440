"""Checks of drafts, searches over cards and methods, and hand-over in batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import hold, numbered

#: Faults of punctuation by what they match (fixed values).
PUNCTUATION = {
    "empty-brackets": r"[\(（]\s*[;；,，]\s*[\)）]",
    "repeated-semicolons": r"[；;]{2,}",
    "comma-and-semicolon": r"[，,]\s*[；;]|[；;]\s*[，,]",
    "after-bracket": r"[）)]\s*[，,]\s*[；;]|[）)]\s*[；;]{2,}",
    "left-over-marker": r"\[\s*[,;，；–—-]+\s*\]",
    "repeated-stops": r"\.\s+\.(?=\s|$)",
}
#: What a draft for publication must not say (fixed values).
BANNED = {
    "聚焦语料": r"聚焦语料", "核心语料": r"核心语料", "全部语料": r"全部语料", "当前语料": r"当前语料", "当前证据": r"当前证据", "本任务": r"本任务",
    "摘要证据": r"摘要(?:级)?证据|证据(?:主要)?(?:来自|以)摘要(?:为主)?|摘要(?:层面|级|报告|所报告|无法|不能)",
    "全文级证据": r"全文级证据|全文(?:不足|有限|核验|可用性)", "直接证据": r"直接证据", "邻近证据": r"邻近证据", "证据等级": r"证据等级", "证据卡": r"证据卡",
    "证据不足提示": r"证据(?:仍|尚|还)?(?:不足|有限)|不足以(?:证明|判断)",
}
#: Statuses of a claim that always ask for a second look (fixed values).
ADVERSE_STATUSES = ("contradict", "mixed", "not-significant")


def labels(text: Column, patterns: dict[str, str]) -> Column:
    """The names of all patterns that a text has."""
    return F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), F.lit(k)) for k, p in patterns.items()]))


def defects(rows: DataFrame, key: str, text: Column, patterns: dict[str, str]) -> DataFrame:
    return rows.select(key, F.explode(labels(text, patterns)).alias("label"))


def batches(rows: DataFrame, done: DataFrame, key: str, size: int = 12) -> DataFrame:
    """Rows that are not done, in order of their key, in numbered batches."""
    left = rows.join(done.select(key).distinct(), key, "left_anti")
    return numbered(left.select(key), key).select(key, F.floor((F.col("number") - 1) / size).cast("long").alias("batch"))


def term_index(cards: DataFrame, key: str, terms: Column) -> DataFrame:
    """Term → the ids of its cards, in order."""
    return cards.select(key, F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.array_join(F.array_sort(F.collect_set(key)).cast("array<string>"), ",").alias("ids"))


def overlap_top(questions: DataFrame, methods: DataFrame, n: int = 4) -> DataFrame:
    """Per question (question_id, goals) the methods (method_id, goals) that share most goals, ties by id.

    Only methods that share a goal are met, by an index of goals. It is held, so that its size is known before the join: where it is
    small it goes to the questions, which then stay where they are.
    """
    q = questions.select("question_id", F.explode(F.array_distinct("goals")).alias("goal"))
    m = hold(methods.select("method_id", F.explode(F.array_distinct("goals")).alias("goal")))
    hit = q.join(m, "goal").groupBy("question_id", "method_id").agg(F.count("*").alias("overlap"))
    place = F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("overlap"), "method_id"))
    return hit.withColumn("place", place.cast("long")).where(F.col("place") <= n)


def search_cards(cards: DataFrame, key: str, name: Column, body: Column, tokens: list[str], n: int = 10) -> DataFrame:
    """Cards by how many of the tokens their name (3 each) or else their text (1 each) contains."""
    score = sum((F.when(F.contains(F.lower(name), F.lit(t)), 3).when(F.contains(F.lower(body), F.lit(t)), 1).otherwise(0) for t in tokens), F.lit(0))
    return cards.select(key, score.cast("long").alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(n)


def group_claims(claims: DataFrame) -> DataFrame:
    """Claims of one subject, predicate, object and direction (null as empty): their records, statuses and anchors, and whether they must be reconciled.

    That is so where statuses differ, where one of them is adverse, and from three records on. Anchors that are null or empty are left out.
    """
    key = ["subject", "predicate", "object", "direction"]
    anchor = F.col("anchor") if "anchor" in claims.columns else F.lit(None).cast("string")
    c = claims.withColumns({k: F.coalesce(k, F.lit("")) for k in key}).withColumn("anchor", F.nullif(anchor, F.lit("")))
    g = c.groupBy(*key).agg(F.array_sort(F.collect_set("record_id")).alias("r"), F.array_sort(F.collect_set("status")).alias("s"), F.array_sort(F.collect_list("anchor")).alias("a"))
    adverse = F.arrays_overlap("s", F.array(*map(F.lit, ADVERSE_STATUSES)))
    return g.select(
        *key, F.array_join(F.col("r").cast("array<string>"), ",").alias("record_ids"), F.array_join("s", ",").alias("statuses"), F.array_join("a", ",").alias("anchors"),
        F.size("r").cast("long").alias("studies"), ((F.size("s") > 1) | adverse | (F.size("r") >= 3)).alias("reconcile"),
    )


def cited_coverage(records: DataFrame, cited: DataFrame, minimum: int) -> DataFrame:
    """Works cited over all and by topic against how many there must be."""
    c = records.join(cited.select("record_id").distinct().withColumn("hit", F.lit(1)), "record_id", "left")
    g = c.groupingSets([[], ["topic_id"]], "topic_id").agg(F.grouping("topic_id").alias("all_"), F.count("*").alias("works"), F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("cited"))
    need = F.when(F.col("all_") == 1, F.least(F.lit(minimum), "works")).otherwise(F.least(F.lit(3), "works")).cast("long")
    return g.where("all_ = 1 or topic_id is not null").select(F.when(F.col("all_") == 1, "all").otherwise(F.concat(F.lit("topic-"), F.col("topic_id").cast("string"))).alias("scope"), "works", "cited", need.alias("minimum"), (F.col("cited") >= need).alias("passed"))


def method_counts(rows: DataFrame, methods: Column) -> DataFrame:
    """(method, mentions) of lists of methods between semicolons, commas and bars."""
    m = rows.select(F.explode(F.split(methods, "[;,；，|]")).alias("m")).select(F.trim("m").alias("method"))
    return m.where("method <> ''").groupBy("method").agg(F.count("*").alias("mentions"))


def seed_recall(texts: DataFrame, seeds: DataFrame) -> DataFrame:
    """(item_id, recalled): whether a seed (item_id, seed) stands in any of the ``texts`` (body), whatever the case.

    A seed's second to fourth words are bounded by spaces on both sides wherever it stands, so texts are met by their runs of
    three words; only seeds of four words or fewer are looked for in every text.
    """
    s = seeds.select("item_id", F.lower("seed").alias("seed"))
    t = texts.select(F.lower("body").alias("body")).where("body is not null").withColumn("of", F.xxhash64("body"))
    words = F.split("seed", " ")
    long = s.where(F.size(words) >= 5).withColumn("key", F.array_join(F.slice(words, 2, 3), " "))
    three = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.array_join(F.slice(w, i, 3), " "))
    # a text's words are bound once: named in the inner function, the text would be split again for each of its runs
    runs = F.flatten(F.transform(F.filter(F.array(F.split("body", " ")), lambda w: F.size(w) >= 3), three))
    pairs = hold(t.select("of", F.explode(runs).alias("key")).join(long, "key").select("of", "item_id", "seed").distinct())
    met = t.join(pairs, "of").where(F.contains("body", "seed")).select("item_id")
    short = t.join(s.where(F.size(words) < 5), F.contains("body", "seed")).select("item_id")
    found = met.unionByName(short).distinct().withColumn("hit", F.lit(True))
    return s.select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("hit", F.lit(False)).alias("recalled"))
