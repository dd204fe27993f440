"""Query op2_secrets: the secrets in every text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .secrets import find_secrets


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
