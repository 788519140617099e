"""Combining algorithms: weights, weighted scores, spread and agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitspark import settings as S
from habitspark.plans.scale import attach, exact_quantiles


def tss_weights(cv: DataFrame, keys: Sequence[str] = ("species",)) -> DataFrame:
    """Weight = mean TSS over folds, not below zero; all zero gives equal weights.

    ``cv`` has one row per species, algorithm and fold with ``tss``.
    """
    mean = cv.groupBy(*keys, "algo").agg(F.avg("tss").alias("cv_tss"))
    raw = mean.withColumn("raw", F.greatest(F.coalesce(F.col("cv_tss"), F.lit(0.0)), F.lit(0.0)))
    total = F.sum("raw").over(Window.partitionBy(*keys))  # a handful of algorithms per species
    return raw.select(*keys, "algo", "cv_tss", F.when(total == 0, F.lit(1.0)).otherwise(F.col("raw")).alias("weight"))


def equal_weights_above(cv: DataFrame, keys: Sequence[str] = ("species",), limit: float = S.TSS_MIN_ENSEMBLE) -> DataFrame:
    """Equal weights for algorithms reaching ``limit``; none reaching it gives all equal."""
    mean = cv.groupBy(*keys, "algo").agg(F.avg("tss").alias("cv_tss"))
    part = Window.partitionBy(*keys)
    good = (F.col("cv_tss") >= limit).cast("double")
    n_good = F.sum(good).over(part)
    n_all = F.count(F.lit(1)).over(part).cast("double")
    weight = F.when(n_good == 0, F.lit(1.0) / n_all).otherwise(good / n_good)
    return mean.select(*keys, "algo", "cv_tss", weight.alias("weight"))


def weights_wide(weights: DataFrame, keys: Sequence[str], algorithms: Sequence[str] = tuple(S.ALGORITHMS)) -> DataFrame:
    wide = weights.groupBy(*keys).pivot("algo", list(algorithms)).agg(F.first("weight"))
    return wide.select(*keys, *[F.coalesce(F.col(a), F.lit(0.0)).alias(f"w_{a}") for a in algorithms])


def with_ensemble(scores: DataFrame, weights: DataFrame, keys: Sequence[str] = ("species",), algorithms: Sequence[str] = tuple(S.ALGORITHMS)) -> DataFrame:
    """Weighted mean over the algorithms a row has a score for; null when their weight is zero."""
    t = attach(scores, weights_wide(weights, keys, algorithms), keys, "left")
    num: Column = F.lit(0.0)
    den: Column = F.lit(0.0)
    for a in algorithms:
        w = F.coalesce(F.col(f"w_{a}"), F.lit(0.0))
        num = num + F.coalesce(w * F.col(a), F.lit(0.0))
        den = den + F.when(F.col(a).isNotNull(), w).otherwise(F.lit(0.0))
    return t.withColumn("ensemble", F.when(den > 0, num / den)).drop(*[f"w_{a}" for a in algorithms])


def lookup_weights(species: DataFrame, weights: DataFrame, algorithms: Sequence[str] = tuple(S.ALGORITHMS)) -> DataFrame:
    """Weights per species and algorithm, zero where none is known."""
    names = F.explode(F.array(*[F.lit(a) for a in algorithms])).alias("algo")
    wanted = species.select("species").distinct().select("species", names)
    known = attach(wanted, weights.select("species", "algo", "weight"), ["species", "algo"], "left")
    return known.withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def row_spread(algorithms: Sequence[str] = tuple(S.ALGORITHMS)) -> Column:
    """Sample standard deviation across algorithms, null when one is missing."""
    n = len(algorithms)
    mean = sum((F.col(a) for a in algorithms[1:]), F.col(algorithms[0])) / F.lit(float(n))
    dev = [(F.col(a) - mean) * (F.col(a) - mean) for a in algorithms]
    return F.sqrt(sum(dev[1:], dev[0]) / F.lit(float(n - 1)))


def algorithm_spread(scores: DataFrame, keys: Sequence[str], algorithms: Sequence[str] = tuple(S.ALGORITHMS)) -> DataFrame:
    rows = scores.select(*keys, row_spread(algorithms).alias("sd"))
    mean = rows.groupBy(*keys).agg(F.avg("sd").alias("algo_sd_mean"))
    return attach(mean, exact_quantiles(rows, keys, "sd", {"algo_sd_median": 0.5}), keys, "left")


def agreement(scores: DataFrame, limits: DataFrame, keys: Sequence[str], algorithms: Sequence[str] = tuple(S.ALGORITHMS)) -> DataFrame:
    """How many algorithms call a presence: mean, possible maximum, share unanimous.

    ``limits`` holds ``t_<algorithm>`` columns, or one shared ``threshold``. A missing
    score calls no presence.
    """
    t = attach(scores, limits, [k for k in keys if k in limits.columns])
    calls = F.lit(0)
    for a in algorithms:
        limit = F.col(f"t_{a}") if f"t_{a}" in limits.columns else F.col("threshold")
        calls = calls + F.coalesce((F.col(a) >= limit).cast("int"), F.lit(0))
    n = F.count(F.lit(1)).cast("double")
    return t.groupBy(*keys).agg(
        (F.sum(calls).cast("double") / n).alias("agreement_mean"),
        F.lit(len(algorithms)).alias("agreement_max"),
        (F.count_if(calls == len(algorithms)).cast("double") * 100.0 / n).alias("unanimous_pct"),
    )
