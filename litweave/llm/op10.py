"""Query op10_fingerprints: I-Match fingerprints of all documents, their edited texts and their next documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .fingerprints import as_text, fingerprints_with_edit


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fingerprints_with_edit(table(spark, sf_dir, "documents"))
    return r.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sig")).alias("fingerprint"),
        as_text(F.col("edited_sig")).alias("edited_fingerprint"), "near_edited", "near_next",
    )
