"""Query op8_quality: quality of every text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .quality import quality


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
