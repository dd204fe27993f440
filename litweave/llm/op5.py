"""Query op5_licences: licences named in every text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .licences import find_licences


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licences(table(spark, sf_dir, "documents"))
