"""Pooling of effects with random effects."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..storage import hold, let_go
from .evidence import working_scale

Z = 1.95996398454


#: Points at which the likelihood is taken in a round, and rounds; each narrows the range to two of the stretches between them.
POINTS, ROUNDS = 65, 6


def variances(effects: DataFrame, groups: DataFrame) -> DataFrame:
    """``groups`` (outcome, metric, centre, top) with ``tau2``: the variance between studies by restricted likelihood, from 0 to ``top``.

    Every round is one aggregate over the effects (outcome, metric, y, s) of all groups: the likelihood at points spread over a group's range. The
    range shrinks to the neighbours of the best point, the lowest of equal ones. No group is in one task, and no range can be left.
    """
    t = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_k") / (POINTS - 1)
    now, held = groups.withColumn("_low", F.lit(0.0)).withColumn("_high", F.col("top")), None
    rows = hold(effects.select("outcome", "metric", "y", (F.col("s") * F.col("s")).alias("_v")))
    for _ in range(ROUNDS):
        e = rows.join(now, ["outcome", "metric"]).select("outcome", "metric", (F.col("y") - F.col("centre")).alias("_d"), "_v", "_low", "_high", F.explode(F.sequence(F.lit(0), F.lit(POINTS - 1))).alias("_k"))
        e = e.withColumn("_t", t).withColumn("_w", 1 / (F.col("_v") + F.col("_t")))
        sums = e.groupBy("outcome", "metric", "_k").agg(F.sum(F.log(F.col("_v") + F.col("_t"))).alias("_l"), F.sum("_w").alias("_sw"), F.sum(F.col("_w") * F.col("_d")).alias("_sd"), F.sum(F.col("_w") * F.col("_d") * F.col("_d")).alias("_sdd"))
        loss = F.col("_l") + F.log("_sw") + F.col("_sdd") - F.col("_sd") * F.col("_sd") / F.col("_sw")
        best = sums.groupBy("outcome", "metric").agg(F.min_by("_k", F.struct(loss, F.col("_k"))).alias("_k"))
        at = now.join(best, ["outcome", "metric"])
        width = (F.col("_high") - F.col("_low")) / (POINTS - 1)
        at = at.withColumn("_near", F.greatest(F.col("_k") - 1, F.lit(0))).withColumn("_far", F.least(F.col("_k") + 1, F.lit(POINTS - 1))).withColumn("tau2", t).withColumn("_width", width).withColumn("_from", F.col("_low"))
        new = hold(at.withColumn("_low", F.col("_from") + F.col("_width") * F.col("_near")).withColumn("_high", F.col("_from") + F.col("_width") * F.col("_far")).select(*groups.columns, "_low", "_high", "tau2"))
        if held is not None:
            let_go(held)
        held, now = new, new.drop("tau2")
    let_go(rows)
    return held.drop("_low", "_high")


@F.pandas_udf(DoubleType())
def both_tails(z: pd.Series) -> pd.Series:
    """Two-sided probability of a normal deviate: one number for each group."""
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)), na_action="ignore")


def back(v: Column) -> Column:
    """A pooled value on the scale of its metric."""
    return F.when(F.col("metric") == "r", F.tanh(v)).when(F.col("metric").isin("or", "rr"), F.exp(v)).otherwise(v)


#: Metrics that can be pooled (fixed values).
METRICS = ("r", "hedges-g", "or", "rr")


def with_reasons(effects: DataFrame) -> DataFrame:
    """Effects with their working scale ``_x`` and ``reason``: why an effect cannot be pooled, null where it can."""
    x = working_scale(F.lower("metric"), F.col("estimate"), F.col("standard_error"), F.col("ci_low"), F.col("ci_high"), F.col("n"))
    absent = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    needed = [c for c in ("outcome", "sample_id", "anchor") if c in effects.columns]
    reason = (
        F.when(~F.coalesce(F.lower("metric"), F.lit("")).isin(*METRICS), F.concat(F.lit("unsupported metric: "), F.coalesce(F.lower("metric"), F.lit(""))))
        .when(F.exists(F.array(*[absent(c) for c in needed]), lambda m: m), f"{', '.join(needed)} are required")
        .when(F.col("_x").isNull(), "no working scale: estimate or its error is absent or out of range")
    )
    return effects.withColumn("_x", x).withColumn("reason", reason)


def rejected(effects: DataFrame) -> DataFrame:
    """(effect_id, reason) of the effects that cannot be pooled."""
    return with_reasons(effects).where("reason is not null").select("effect_id", "reason")


def duplicate_samples(effects: DataFrame) -> DataFrame:
    """(effect_id, sample_id, outcome, metric): valid effects whose sample has another of the same outcome and metric."""
    ok = with_reasons(effects).where("reason is null")
    n = F.count("*").over(W.partitionBy("outcome", "metric", "sample_id"))
    return ok.withColumn("_n", n).where("_n > 1").select("effect_id", "sample_id", "outcome", "metric")


def valid_effects(effects: DataFrame) -> DataFrame:
    """Effects on their working scale, the first of each sample; ``rejected`` tells why others are left out."""
    more = ["subgroup"] if "subgroup" in effects.columns else []
    ok = with_reasons(effects).where("reason is null")
    first = F.row_number().over(W.partitionBy("outcome", "metric", "sample_id").orderBy("effect_id"))
    return ok.withColumn("_first", first).where("_first = 1").select("effect_id", "outcome", "metric", "sample_id", "moderator", *more, F.col("_x.y").alias("y"), F.col("_x.s").alias("s"))


def pooled(effects: DataFrame) -> DataFrame:
    """Per outcome and metric of ``valid_effects``: the pooled effect and its ranges, Egger's test from ten studies on, and a regression on the moderator.

    All of it is sums over the effects, taken about a group's mean. Fewer than three studies are not pooled; a regression needs ten
    effects with a moderator of three different values or more.
    """
    x = F.when(F.abs(F.col("moderator").cast("double")) < float("inf"), F.col("moderator").cast("double"))  # neither null nor NaN nor infinite
    keys = ["outcome", "metric"]
    e = hold(effects.select(*keys, F.col("y").cast("double").alias("y"), F.col("s").cast("double").alias("s"), x.alias("x")))
    groups = hold(e.groupBy(*keys).agg(F.count("*").alias("studies"), F.avg("y").alias("centre"), F.greatest(F.var_pop("y") * 10, F.lit(0.01)).alias("top"), F.avg("x").alias("_cx"), F.min("x").alias("_x0"), F.max("x").alias("_x1")))
    ready = variances(e, groups.where("studies >= 3"))
    d, f, w = F.col("y") - F.col("centre"), 1 / (F.col("s") * F.col("s")), 1 / (F.col("s") * F.col("s") + F.col("tau2"))
    r, u = e.join(ready, keys), F.col("x") - F.col("_cx")
    g = F.when(F.col("x").isNotNull(), f)
    a, b = F.col("y") / F.col("s"), 1 / F.col("s")
    sums = r.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("studies", "centre", "tau2")], F.sum(w).alias("_w"), F.sum(w * d).alias("_wd"), F.sum(f).alias("_f"), F.sum(f * d).alias("_fd"), F.sum(f * d * d).alias("_fdd"),
        (F.max(b) - F.min(b)).alias("_spread"), F.regr_intercept(a, b).alias("_cut"), F.regr_sxx(a, b).alias("_sxx"), F.regr_syy(a, b).alias("_syy"), F.regr_sxy(a, b).alias("_sxy"), F.avg(b).alias("_b"),
        F.count("x").alias("_n"), F.count_if((F.col("x") > F.col("_x0")) & (F.col("x") < F.col("_x1"))).alias("_amid"),
        F.sum(g).alias("_g"), F.sum(g * u).alias("_gu"), F.sum(g * u * u).alias("_guu"), F.sum(g * d).alias("_gd"), F.sum(g * u * d).alias("_gud"),
    )
    mean, se2 = F.col("centre") + F.col("_wd") / F.col("_w"), 1 / F.col("_w")
    q = F.greatest(F.lit(0.0), F.col("_fdd") - F.col("_fd") * F.col("_fd") / F.col("_f"))
    k = F.col("studies")
    left = F.greatest(F.lit(0.0), F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx"))
    error = F.sqrt(left / (k - 2) * (1 / k + F.col("_b") * F.col("_b") / F.col("_sxx")))
    tested = (k >= 10) & (F.col("_spread") > 1e-12)
    suu = F.col("_guu") - F.col("_gu") * F.col("_gu") / F.col("_g")
    sloped = (F.col("_n") >= 10) & (F.col("_amid") > 0)
    wide = lambda v: (back(mean - Z * F.sqrt(v)), back(mean + Z * F.sqrt(v)))
    (low, high), (far_low, far_high) = wide(se2), wide(F.col("tau2") + se2)
    done = sums.select(
        *keys, "studies", F.lit("ready").alias("status"), back(mean).alias("pooled"), low.alias("ci_low"), high.alias("ci_high"), far_low.alias("prediction_low"), far_high.alias("prediction_high"), "tau2", q.alias("q"),
        F.when(q > 0, F.greatest(F.lit(0.0), (q - k + 1) / q * 100)).otherwise(0.0).alias("i2"), F.when(tested, F.col("_cut")).alias("egger_intercept"), both_tails(F.when(tested & (error > 0), F.col("_cut") / error)).alias("egger_p"),
        F.when(sloped, (F.col("_gud") - F.col("_gu") * F.col("_gd") / F.col("_g")) / suu).alias("slope"), F.when(sloped, 1 / F.sqrt(suu)).alias("slope_error"),
    )
    few = groups.where("studies < 3").select(*keys, "studies", F.lit("skipped-insufficient-data").alias("status"))
    return done.unionByName(few, allowMissingColumns=True)


def subgroups(effects: DataFrame, least: int = 3, groups: int = 2) -> DataFrame:
    """``pooled`` by subgroup, where an outcome and metric has at least two subgroups of three effects or more."""
    named = effects.where("trim(coalesce(subgroup, '')) <> ''")
    sizes = named.groupBy("outcome", "metric", "subgroup").agg(F.count("*").alias("k")).where(F.col("k") >= least)
    some = sizes.groupBy("outcome", "metric").agg(F.count("*").alias("groups")).where(F.col("groups") >= groups)
    part = named.join(sizes.join(some, ["outcome", "metric"]).select("outcome", "metric", "subgroup"), ["outcome", "metric", "subgroup"])
    # the pair of outcome and subgroup stands for the outcome while pooling
    out = pooled(part.withColumn("outcome", F.to_json(F.struct("outcome", "subgroup"))))
    pair = F.from_json("outcome", "outcome string, subgroup string")
    return out.withColumn("_p", pair).select(F.col("_p.outcome").alias("outcome"), F.col("_p.subgroup").alias("subgroup"), *[c for c in out.columns if c != "outcome"])


def effect_violations(effects: DataFrame, records: DataFrame) -> DataFrame:
    """(effect_id, rule): completed effects of unknown records, or without an anchor."""
    done = effects.where("extraction_status = 'completed'")
    unknown = done.join(records.select("record_id").distinct(), "record_id", "left_anti").select("effect_id", F.lit("unknown record_id").alias("rule"))
    return unknown.unionByName(done.where("trim(coalesce(anchor, '')) = ''").select("effect_id", F.lit("missing anchor").alias("rule")))
