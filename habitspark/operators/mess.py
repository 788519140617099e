"""Environmental similarity of rows to a reference sample."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from habitspark.plans.scale import attach, exact_quantiles, join_hot, measured, running_totals, stored


def _similarity(f: Column, p: Column, low: Column, high: Column) -> Column:
    """Similarity of value p: f is the share of the reference at or below it."""
    span = high - low
    below = F.when(span == 0, F.lit(0.0)).otherwise((p - low) / F.when(span != 0, span) * 100.0)
    above = F.when(span == 0, F.lit(0.0)).otherwise((p - high) / F.when(span != 0, span) * 100.0)
    s = F.when((f == 0) | (p < low), below).when(f <= 0.5, 200.0 * f).when(f < 1.0, 200.0 * (1.0 - f)).otherwise(above)
    return F.when(p.isNotNull() & f.isNotNull(), s)


def _column(values: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Similarity of many values of one variable to its sorted reference."""
    if len(ref) == 0:
        return np.full(len(values), np.nan)
    low, high = ref[0], ref[-1]
    f = np.searchsorted(ref, values, side="right") / len(ref)
    span = high - low
    below = (values - low) / span * 100.0 if span else np.zeros(len(values))
    above = (values - high) / span * 100.0 if span else np.zeros(len(values))
    s = np.select([f == 0, f <= 0.5, f < 1.0], [below, 200.0 * f, 200.0 * (1.0 - f)], above)
    return np.where(np.isnan(values), np.nan, s)


def mess(reference: DataFrame, query: DataFrame, variables: Sequence[str], keys: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Smallest similarity over the variables per query row: (keys, ids, mess).

    Negative values mean extrapolation; variables without a value are left out. A
    reference of checked size goes to every task and the query is not shuffled; a larger
    one is ranked together with the query values, variable by variable.
    """
    columns = list(variables)

    def known(v: str) -> Column:
        value = F.col(v).cast("double")
        return F.when(~F.isnan(value), value).alias(v)  # not a number is no value

    ref = reference.select(*keys, *[known(v) for v in columns])
    query = query.select(*keys, *[c for c in ids if c not in keys], *[known(v) for v in columns if v not in ids])
    groups = list(keys)
    if not groups:
        ref, query, groups = ref.withColumn("_all", F.lit(0)), query.withColumn("_all", F.lit(0)), ["_all"]
    kept, small = measured(ref)
    if small:
        return _mess_searched(kept, query, columns, groups, ids).select(*keys, *ids, "mess")
    return _mess_ranked(ref, query, columns, groups, ids).select(*keys, *ids, "mess")


def _mess_searched(ref: DataFrame, query: DataFrame, columns: Sequence[str], groups: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Binary search in the sorted reference, which every task holds; the query stays in place."""
    packed = ref.groupBy(*groups).agg(*[F.sort_array(F.collect_list(F.col(v).cast("double"))).alias(v) for v in columns])
    # within the measured size limit
    arrays = {tuple(r[g] for g in groups): [np.array(r[v], dtype=float) for v in columns] for r in packed.collect()}
    shared = ref.sparkSession.sparkContext.broadcast(arrays)
    rows = query.select(*groups, *ids, *[F.col(v).cast("double").alias(v) for v in columns])
    schema = T.StructType([*rows.select(*groups, *ids).schema.fields, T.StructField("mess", T.DoubleType())])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, part in batch.groupby(list(groups), dropna=False):
                found = shared.value.get(key)
                out = part[[*groups, *ids]].copy()
                if found is None:
                    out["mess"] = np.nan
                else:
                    sims = np.column_stack([_column(part[v].to_numpy(dtype=float), r) for v, r in zip(columns, found)])
                    # the smallest known similarity; a row without any stays unknown
                    smallest = np.where(np.isnan(sims), np.inf, sims).min(axis=1)
                    out["mess"] = np.where(np.isinf(smallest), np.nan, smallest)
                yield out

    scored = rows.mapInPandas(score, schema)
    return scored.withColumn("mess", F.when(~F.isnan("mess"), F.col("mess")))


def _mess_ranked(ref: DataFrame, query: DataFrame, columns: Sequence[str], groups: Sequence[str], ids: Sequence[str]) -> DataFrame:
    def long(df: DataFrame, extra: Sequence[str]) -> DataFrame:
        rows = F.explode(F.array(*[F.struct(F.lit(v).alias("var"), F.col(v).cast("double").alias("value")) for v in columns]))
        return df.select(*groups, *extra, rows.alias("_v")).select(*groups, *extra, "_v.var", "_v.value").filter("value IS NOT NULL")

    # rows are told apart by a number of their own, ids may repeat
    query = stored(query.withColumn("_row", F.monotonically_increasing_id()))
    ours = long(ref, []).withColumn("n", F.lit(1))
    asked = long(query, ["_row"])
    values = ours.unionByName(asked.select(*groups, "var", "value", F.lit(0).alias("n"))).groupBy(*groups, "var", "value").agg(F.sum("n").alias("n"))
    ranks = running_totals(values, [*groups, "var"], "value", ["n"])
    ends = ours.groupBy(*groups, "var").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    t = attach(ranks, ends, [*groups, "var"])
    f = F.when(F.col("tot_n") > 0, F.col("cum_n").cast("double") / F.col("tot_n").cast("double"))
    sim = t.select(*groups, "var", "value", _similarity(f, F.col("value"), F.col("low"), F.col("high")).alias("sim"))
    scored = join_hot(asked, sim, [*groups, "var", "value"], "left")
    found = scored.groupBy("_row").agg(F.min("sim").alias("mess"))
    return query.select(*groups, *ids, "_row").join(found, "_row", "left").drop("_row")


def mess_median(reference: DataFrame, query: DataFrame, variables: Sequence[str], keys: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Simplified variant around the reference median; zero outside the range, never below.

    A row with a missing variable has no value.
    """
    t = query
    parts = []
    for v in variables:
        ends = reference.groupBy(*keys).agg(F.min(v).alias(f"_lo_{v}"), F.max(v).alias(f"_hi_{v}"))
        mid = exact_quantiles(reference, keys, v, {f"_md_{v}": 0.5})
        t = attach(attach(t, ends, keys), mid, keys)
        p, lo, hi, md = F.col(v), F.col(f"_lo_{v}"), F.col(f"_hi_{v}"), F.col(f"_md_{v}")

        def clip(c: Column) -> Column:
            return F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0))

        s = F.when((p <= lo) | (p >= hi), F.lit(0.0)).when(p <= md, clip((p - lo) / (md - lo + 1e-9) * 100.0))
        parts.append(F.when(p.isNotNull(), s.otherwise(clip((hi - p) / (hi - md + 1e-9) * 100.0))))
    known = F.lit(True)
    for v in variables:
        known = known & F.col(v).isNotNull()
    return t.select(*keys, *ids, F.when(known, F.array_min(F.array(*parts))).alias("mess"))


def summary(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    return values.groupBy(*keys).agg(
        F.avg("mess").alias("mess_mean"),
        F.min("mess").alias("mess_min"),
        F.max("mess").alias("mess_max"),
        extrapolated().alias("mess_pct_extrapolation"),
        F.count("mess").alias("n_points"),
    )


def extrapolated() -> Column:
    """Share of rows with a value that lie below zero, in percent."""
    n = F.count("mess")
    return F.when(n > 0, F.count_if(F.col("mess") < 0).cast("double") * 100.0 / F.when(n > 0, n.cast("double")))


def outside_range(reference: DataFrame, query: DataFrame, variables: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Percent of query rows with any variable beyond the range of the reference."""
    ends = reference.groupBy(*keys).agg(*[x for v in variables for x in (F.min(v).alias(f"_lo_{v}"), F.max(v).alias(f"_hi_{v}"))])
    out = F.lit(False)
    for v in variables:
        out = out | F.coalesce((F.col(v) < F.col(f"_lo_{v}")) | (F.col(v) > F.col(f"_hi_{v}")), F.lit(False))
    t = attach(query, ends, keys)
    return t.groupBy(*keys).agg((F.count_if(out).cast("double") * 100.0 / F.count(F.lit(1)).cast("double")).alias("pct_outside"))
