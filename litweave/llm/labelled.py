"""Bounded samples of labelled rows, and folds by a checksum of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def seeded(seed: int) -> Column:
    return F.xxhash64("doc_id", F.lit(seed))


def one_label(labels: DataFrame, name: str) -> DataFrame:
    """(doc_id, y): one row for each id that has a label of 0 or 1; of several labels the largest."""
    return labels.where(F.col(name).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(name).cast("int").alias("y"))


def sample(ids: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows of ``ids``, by a seeded hash of doc_id; a table of proven size."""
    return cut(ids.orderBy(seeded(seed), "doc_id").limit(most))


def texts_of(docs: DataFrame, few: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) whose id is in the bounded table ``few``, with its columns."""
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
