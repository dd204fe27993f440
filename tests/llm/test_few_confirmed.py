"""Toxicity with few confirmed rows: few false alarms, and most of the corpus stays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from litweave.llm import toxicity


@pytest.mark.parametrize("most", [0, 1, 2, 8, 30])
def test_clean_text_stays_with_few_confirmed_rows(spark, sf, most):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 300").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("doc_id < 300")
    toxic = [r["doc_id"] for r in labels.where("toxic = 1").orderBy("doc_id").collect()][:most]
    few = labels.where(F.col("toxic") == 0).unionByName(labels.where(F.col("doc_id").isin(toxic))) if toxic else labels.where("toxic = 0")
    n, share = docs.count(), few.where("toxic = 1").count() / max(few.count(), 1)
    found = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, few).collect()}
    flagged = {i for i, p in found.items() if p}
    assert len(flagged) <= 3 * max(share, 1e-4) * n + 1
    fine = {r["doc_id"] for r in labels.where("toxic = 0").collect()}
    assert len(flagged & fine) <= 0.15 * len(fine) and len(found) == n
    if most == 2:
        assert {r["doc_id"] for r in toxicity.clean(docs, few).collect()} == set(found) - flagged and len(flagged) <= 0.25 * n


def test_the_flagged_share_is_bounded_and_the_prior_where_little_is_known():
    n, prior = 1000.0, 0.1
    # every row of one score: flagging all has the largest F1
    steps = np.where(toxicity.SHIFTS >= 1, n, 0.0)
    many = [np.zeros(50), np.zeros(50)]
    assert np.interp(toxicity.flagging(many, steps, steps, n, prior, 0.3), toxicity.SHIFTS, steps) == 0
    # toxic rows well apart: the best shift is taken with many confirmed rows, the prior's share with few
    rows = np.concatenate([np.full(150, 3.0), np.linspace(-6, -2, 850)])
    found = (rows[:, None] + toxicity.SHIFTS >= toxicity.logit(0.3)).sum(axis=0).astype(float)
    for known in ([np.full(30, 3.0)] * 2, [np.full(2, 3.0)] * 2):
        shift = toxicity.flagging(known, found, found, n, 0.15, 0.3)
        assert np.interp(shift, toxicity.SHIFTS, found) == 150
    assert toxicity.best_shift(np.zeros(50), steps, n, prior, 0.3) is None
