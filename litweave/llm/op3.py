"""Query op3_toxicity: toxicity of every text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .toxicity import toxicity


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
