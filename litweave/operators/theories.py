"""Theory cards from pages, and the state of each card as its history gives it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_text, html_title
from .ledgers import theory_id, theory_name

#: What may happen to a card; ``complete`` is a review that has all parts of the card.
ACTIONS = ("ingest", "complete", "confirm", "disable", "update")
EXCERPT = 4000


def path_parts(url: Column) -> tuple[Column, Column]:
    """(name of the file without its suffix, name of its folder) of an address; empty where there is none."""
    parts = F.filter(F.split(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[a-z]+://|[?#].*$", ""), "/"), lambda x: x != "")
    n = F.size(parts)
    last = F.coalesce(F.get(parts, n - 1), F.lit(""))
    return F.regexp_replace(last, r"\.[A-Za-z0-9]+$", ""), F.coalesce(F.get(parts, n - 2), F.lit(""))


def ingest_pages(pages: DataFrame) -> DataFrame:
    """A candidate card for each theory that ``pages`` (url, html) name, with the pages it comes from.

    The first page by address gives name and excerpt; sources and hashes are in the order of addresses without repeats. Null
    pages count as empty ones and go by their address. Further columns are ignored; of equal pages one counts.
    """
    html = F.coalesce("html", F.lit(""))
    stem, parent = path_parts(F.col("url"))
    read = pages.select(F.coalesce("url", F.lit("")).alias("source"), F.sha2(html, 256).alias("hash"), html_text(html).alias("text"), F.regexp_replace(html_title(html), r"\s+", " ").alias("title"), stem.alias("stem"), parent.alias("parent"))
    named = read.withColumn("name", theory_name(F.col("stem"), F.col("parent"), F.col("title"), F.col("text")))
    p = named.select(theory_id(F.col("name")).alias("theory_id"), "name", "source", "hash", F.substring(F.regexp_replace("text", r"\s+", " "), 1, EXCERPT).alias("excerpt")).dropDuplicates(["theory_id", "source", "hash"])
    first = F.min(F.struct("source", "hash", "name", "excerpt"))
    seen = F.array_sort(F.collect_list(F.struct("source", "hash")))
    g = p.groupBy("theory_id").agg(first.alias("_first"), seen.alias("_seen"))
    name = F.col("_first.name")
    chinese = name.rlike("[一-鿿]")
    return g.select(
        "theory_id", F.when(chinese, name).otherwise("").alias("name_zh"), F.when(chinese, "").otherwise(name).alias("name_en"), F.array_distinct(F.transform("_seen", lambda x: x["source"])).alias("source_files"),
        F.array_distinct(F.transform("_seen", lambda x: x["hash"])).alias("source_hashes"), F.col("_first.excerpt").alias("source_excerpt"), F.lit("candidate").alias("verification_status"), F.lit("pending").alias("host_review_status"),
    )


def milestones(events: DataFrame) -> DataFrame:
    """(theory_id, ingested, located, verified, disabled): when each card came to each of its states, null where it did not.

    ``events`` are (theory_id, at, action); ``at`` orders those of a card. A card is there from its first ``ingest`` on and
    ends with its first ``disable``; between them the first ``complete`` locates its source and the first ``confirm`` after that
    verifies it. Each is a minimum over the events, so they may come in any order and any number of times, and a card of any number of
    events is aggregated before it is shuffled.
    """
    e = events.select("theory_id", "at", "action").where("theory_id is not null and at is not null")

    def first(marks: DataFrame, action: str, name: str, when: str) -> DataFrame:
        found = e.where(F.col("action") == action).join(marks, "theory_id").where(when).groupBy("theory_id").agg(F.min("at").alias(name))
        return marks.join(found, "theory_id", "left")

    marks = e.where("action = 'ingest'").groupBy("theory_id").agg(F.min("at").alias("ingested"))
    marks = first(marks, "disable", "disabled", "at > ingested")
    marks = first(marks, "complete", "located", "at > ingested and (disabled is null or at < disabled)")
    marks = first(marks, "confirm", "verified", "at > located and (disabled is null or at < disabled)")
    return marks.select("theory_id", "ingested", "located", "verified", "disabled")


def card_states(events: DataFrame) -> DataFrame:
    """``milestones`` with the present state of each card."""
    state = F.when(F.col("disabled").isNotNull(), "disabled").when(F.col("verified").isNotNull(), "content-verified").when(F.col("located").isNotNull(), "source-located").otherwise("candidate")
    return milestones(events).withColumn("verification_status", state)


def illegal_steps(events: DataFrame) -> DataFrame:
    """(rule, theory_id, at): events of unknown kinds, those of cards that are not there yet, and confirmations of cards whose source is not located."""
    e = events.select("theory_id", "at", "action").distinct()
    m = e.join(milestones(events), "theory_id", "left")
    unknown = ~F.coalesce("action", F.lit("")).isin(*ACTIONS)
    absent = F.col("ingested").isNull() | (F.col("at") < F.col("ingested"))
    located = (F.col("at") > F.col("located")) & (F.col("verified").isNull() | (F.col("at") <= F.col("verified"))) & (F.col("disabled").isNull() | (F.col("at") < F.col("disabled")))
    rule = F.when(unknown, "unknown-action").when((F.col("action") != "ingest") & F.coalesce(absent, F.lit(True)), "theory-not-found").when((F.col("action") == "confirm") & ~F.coalesce(located, F.lit(False)), "not-source-located")
    return m.select(rule.alias("rule"), "theory_id", "at").where("rule is not null")


def revise_cards(cards: DataFrame, updates: DataFrame, lists: list[str], scalars: list[str]) -> tuple[DataFrame, DataFrame]:
    """(``cards`` with ``updates`` merged into them, (rule, id) of updates of cards that are not there).

    Lists are joined in order without repeats, scalars filled where absent; what a card holds is never replaced. There is at most one
    update for each card.
    """
    from .ledgers import merge_cards

    known = updates.join(cards.select("theory_id"), "theory_id", "left_semi")
    lost = updates.join(cards.select("theory_id"), "theory_id", "left_anti").select(F.lit("theory-not-found").alias("rule"), F.col("theory_id").alias("id"))
    return merge_cards(cards, known, lists, scalars), lost
