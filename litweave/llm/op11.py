"""Query op11_lm_scoring: the log-probability of every text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .backoff import log_probabilities
from .common import table


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_probabilities(table(spark, sf_dir, "documents"))
