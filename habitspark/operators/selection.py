"""Predictor statistics and the choice of non-collinear predictors per group.

One aggregate over the rows yields the correlation matrix of each group; everything
after it works on that p x p matrix.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitspark import settings as S


def scaler(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation per feature; no deviation counts as 1."""
    aggs = []
    for f in features:
        sd = F.stddev_pop(f)
        aggs.append(F.struct(F.lit(f).alias("feature"), F.avg(f).alias("mean"), F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias("sd")))
    return df.groupBy(*keys).agg(F.array(*aggs).alias("s")).select(*keys, F.explode("s").alias("s")).select(*keys, "s.*")


def _correlation(a: str, b: str) -> Column:
    """Pearson r, null without variation."""
    va, vb = F.var_samp(a), F.var_samp(b)
    r = F.covar_samp(a, b) / F.sqrt(va * vb)
    return F.when((va > 0) & (vb > 0), r)


def moments(df: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Complete rows per group: count, variances and pairwise correlations."""
    rows = df.na.drop(subset=list(features))
    pairs = list(combinations(features, 2))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.var_samp(f) for f in features]).alias("var"),
        F.array(*[_correlation(a, b) for a, b in pairs]).cast("array<double>").alias("r"),
    )


def correlations(df: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Long correlation table with one row per pair."""
    pairs = list(combinations(features, 2))
    rows = F.explode(
        F.array(*[F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), F.col("r")[i].alias("r")) for i, (a, b) in enumerate(pairs)])
    )
    return moments(df, features, keys).select(*keys, rows.alias("p")).select(*keys, "p.*")


def correlated_pairs(df: DataFrame, features: Sequence[str], keys: Sequence[str], limit: float = S.CORRELATION_LIMIT) -> DataFrame:
    return correlations(df, features, keys).filter(F.abs("r") >= limit)


def _matrix(r: Sequence[float], p: int) -> np.ndarray:
    m = np.eye(p)
    m[np.triu_indices(p, 1)] = [np.nan if v is None else v for v in r]
    return np.where(np.tri(p, k=-1, dtype=bool), m.T, m)


def inflation(m: np.ndarray) -> np.ndarray:
    """Variance inflation of each variable from a correlation matrix.

    A variable without variation (undefined correlations) gets 1, an exactly explained
    one infinity.
    """
    p = len(m)
    moving = ~np.isnan(np.where(np.eye(p, dtype=bool), np.nan, m)).all(axis=1) if p > 1 else np.ones(p, bool)
    out = np.ones(p)
    for j in np.flatnonzero(moving):
        others = np.array([i for i in np.flatnonzero(moving) if i != j], dtype=int)
        if len(others) == 0:
            continue
        beta = np.linalg.lstsq(m[np.ix_(others, others)], m[others, j], rcond=None)[0]
        r2 = float(m[others, j] @ beta)
        out[j] = np.inf if r2 >= 1.0 - 1e-12 else 1.0 / (1.0 - r2)
    return out


def uncorrelated(features: Sequence[str], limit: float) -> Column:
    """Positions of the features left after the correlation rule, from columns ``var`` and ``r``.

    Pairs are taken in the order of the features, those of one first feature as a run. In a pair beyond the limit the less
    variable feature goes, the later one on ties. Runs of a feature that is gone by then, and pairs whose
    second feature is gone, do not count.
    """
    order = list(combinations(range(len(features)), 2))
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("r")[i].alias("r")) for i, (a, b) in enumerate(order)])
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("gone"), F.lit(-1).alias("lead"), F.lit(True).alias("open"))

    def step(state: Column, p: Column) -> Column:
        gone = state["gone"]
        is_open = F.when(p["a"] == state["lead"], state["open"]).otherwise(~F.array_contains(gone, p["a"]))
        over = F.coalesce(F.abs(p["r"]) > limit, F.lit(False)) & is_open & ~F.array_contains(gone, p["b"])
        first, second = F.get("var", p["a"]), F.get("var", p["b"])
        loser = F.when(first >= second, p["b"]).otherwise(p["a"])
        after = F.when(over, F.array_union(gone, F.array(loser))).otherwise(gone)
        return F.struct(after.alias("gone"), p["a"].alias("lead"), is_open.alias("open"))

    everything = F.lit(list(range(len(features)))) if features else none
    return F.array_except(everything, F.aggregate(pairs, start, step)["gone"]) if order else everything


def deflated(kept: list[int], n: int, m: np.ndarray, limit: float) -> list[int]:
    """Leave out the most inflated variable until none exceeds the limit or rows run short."""
    kept = list(kept)
    while len(kept) > 1 and n >= len(kept) + 1:
        v = inflation(m[np.ix_(kept, kept)])
        if v.max() <= limit:
            break
        kept.pop(int(v.argmax()))
    return kept


def vif(df: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Variance inflation per group and feature."""
    names = list(features)
    t = moments(df, names, keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in t.select(*keys).schema) + ", feature string, vif double"

    def per_batch(batches):
        for batch in batches:
            out = []
            for _, g in batch.iterrows():
                v = inflation(_matrix(g["r"], len(names)))
                out += [{**{k: g[k] for k in keys}, "feature": f, "vif": float(x)} for f, x in zip(names, v)]
            if out:
                yield pd.DataFrame(out)

    return t.mapInPandas(per_batch, schema)


def select_predictors(
    df: DataFrame,
    features: Sequence[str],
    keys: Sequence[str],
    corr_limit: float = S.CORRELATION_LIMIT,
    vif_limit: float = S.VIF_LIMIT,
) -> DataFrame:
    """Chosen predictors per group with their position; groups without complete rows keep all."""
    names = list(features)
    t = df.select(*keys).distinct().join(moments(df, names, keys).withColumn("kept", uncorrelated(names, corr_limit)), list(keys), "left")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in t.select(*keys).schema) + ", predictor string, position int"

    def per_batch(batches):
        for batch in batches:
            out = []
            for _, g in batch.iterrows():
                if pd.isna(g["n"]):
                    kept = list(range(len(names)))
                else:
                    kept = deflated(list(g["kept"]), int(g["n"]), _matrix(g["r"], len(names)), vif_limit)
                out += [{**{k: g[k] for k in keys}, "predictor": names[f], "position": i} for i, f in enumerate(kept)]
            if out:
                yield pd.DataFrame(out)

    return t.mapInPandas(per_batch, schema)
