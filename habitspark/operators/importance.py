"""Predictor importance: permutation runs and the tables made of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from habitspark import settings as S
from habitspark.operators import metrics as M
from habitspark.operators import models as MD
from habitspark.plans.scale import stored, hash_unit, running_totals


def _ordered(df: DataFrame, ids: Sequence[str], seed: int, columns: Sequence[str]) -> DataFrame:
    """Rows numbered in a hashed order."""
    t = df.select(*columns, F.lit(0).alias("_all"), F.struct(hash_unit(*[F.col(i) for i in ids], seed=seed), *ids).alias("_at"), F.lit(1).alias("_one"))
    return running_totals(t, ["_all"], "_at", ["_one"]).select(*columns, F.col("cum__one").alias("_place"))


def permuted(df: DataFrame, ids: Sequence[str], predictors: Sequence[str], repeats: int, seed: int = S.SEED) -> DataFrame:
    """Copies of the rows in which one predictor at a time is shuffled.

    Each repeat pairs every row with a partner by joining two hashed orders; the copy for
    a predictor takes that value from the partner.
    """
    base = stored(_ordered(df, ids, seed, df.columns))
    out = None
    for r in range(repeats):
        partner = _ordered(df, ids, seed + 1 + r, predictors).withColumnsRenamed({p: f"_o_{p}" for p in predictors})
        pairs = base.join(partner, "_place").withColumn("repeat", F.lit(r))
        out = pairs if out is None else out.unionByName(pairs)
    names = F.explode(F.array(*[F.lit(p) for p in predictors]))
    copies = out.withColumn("variable", names)
    swapped = {p: F.when(F.col("variable") == p, F.col(f"_o_{p}")).otherwise(F.col(p)) for p in predictors}
    return copies.withColumns(swapped).drop("_place", *[f"_o_{p}" for p in predictors])


def permutation_importance(model: MD.Model, df: DataFrame, ids: Sequence[str], repeats: int = 8, seed: int = S.SEED) -> DataFrame:
    """Mean loss of AUC per predictor when its values are shuffled."""
    rows = df.select(*ids, "presence", *model.predictors)
    full = M.auc(model.score(rows).withColumn("_g", F.lit(0)), ["_g"], model.algo).select(F.col("auc").alias("base"), F.lit(0).alias("_g"))
    shuffled = M.auc(model.score(permuted(rows, ids, model.predictors, repeats, seed)), ["variable", "repeat"], model.algo)
    drop = shuffled.withColumn("_g", F.lit(0)).join(F.broadcast(full), "_g")  # a single row
    return drop.groupBy("variable").agg(F.avg(F.col("base") - F.col("auc")).alias("importance"))


def ensemble_importance(models: Mapping[str, MD.Model], weights: Mapping[str, float], df: DataFrame, ids: Sequence[str], repeats: int = 8) -> DataFrame:
    """Weighted mean over the algorithms in use, floored at zero each, in percent."""
    total, parts = sum(w for a, w in weights.items() if a in models and w > 0), None
    for a, m in models.items():
        w = weights.get(a, 0.0)
        if w <= 0:
            continue
        one = permutation_importance(m, df, ids, repeats).select("variable", (F.greatest("importance", F.lit(0.0)) * (w / total)).alias("part"))
        parts = one if parts is None else parts.unionByName(one)
    sums = parts.groupBy("variable").agg(F.sum("part").alias("importance"))
    whole = F.sum("importance").over(Window.partitionBy(F.lit(0)))  # one row per predictor
    return sums.withColumn("pct", F.when(whole > 0, F.col("importance") * 100.0 / whole).otherwise(F.col("importance")))


def top(importance: DataFrame, k: int = 5, digits: int = 3) -> DataFrame:
    """The k strongest variables per species as labelled columns."""
    w = Window.partitionBy("species").orderBy(F.desc("value"), "variable")
    label = F.concat(F.col("variable"), F.lit(" ("), F.format_string(f"%.{digits}f", F.col("value")), F.lit(")"))
    ranked = importance.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    wide = ranked.select("species", F.concat(F.lit("top"), F.col("rank").cast("string")).alias("rank"), label.alias("label"))
    return wide.groupBy("species").pivot("rank", [f"top{i}" for i in range(1, k + 1)]).agg(F.first("label"))


def matrix(importance: DataFrame, variables: Sequence[str], digits: int = 4) -> DataFrame:
    return importance.groupBy("species").pivot("variable", list(variables)).agg(F.round(F.first("value"), digits))


def summary(importance: DataFrame) -> DataFrame:
    """Frequency and size of the importance of each variable over species."""
    return importance.groupBy("variable").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.max("value").alias("max")
    ).orderBy(F.desc("mean"))


def global_ranking(importance: DataFrame) -> DataFrame:
    return importance.groupBy("variable").agg(F.avg("value").alias("mean")).orderBy(F.desc("mean"))
