"""Query op1_token_counts: token counts of all documents before and after three edits each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .token_tree import edited_counts


def three_edits(docs: DataFrame) -> DataFrame:
    """Adds edits: five characters at a third of the text become "edited ", a line is put in at two thirds, and the last seven characters go."""
    n = F.coalesce(F.char_length("text"), F.lit(0))
    third = F.floor(n / 3).cast("int")
    late = F.floor(2 * n / 3).cast("int")
    one = lambda a, b, t: F.struct(a.cast("int").alias("start"), b.cast("int").alias("stop"), F.lit(t).alias("text"))
    return docs.select("doc_id", "text", F.array(one(third, third + 5, "edited "), one(late, late, "\nA new line, it's 42!\n"), one(n + 16, n + 40, "")).alias("edits"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_counts(three_edits(table(spark, sf_dir, "documents")))
