"""Repair of stored terrain values and the log of what changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitspark import settings as S
from habitspark.operators.cleaning import failed_topography
from habitspark.plans.scale import exact_quantiles


def repair_topography(df: DataFrame, names: Sequence[str] = tuple(S.TERRAIN)) -> DataFrame:
    """Overwrite terrain columns of failed rows by ``new_<name>``.

    Adds ``corrected`` and ``still_missing`` and keeps the old values as ``<name>_before``.
    """
    failed = F.coalesce(failed_topography(names), F.lit(False))
    t = df.withColumn("corrected", failed)
    t = t.withColumns({f"{n}_before": F.col(n) for n in names})
    t = t.withColumns({n: F.when(F.col("corrected"), F.col(f"new_{n}")).otherwise(F.col(n)) for n in names})
    return t.withColumn("still_missing", F.col("corrected") & F.col(names[0]).isNull())


def change_log(repaired: DataFrame, key: str = "rec_id") -> DataFrame:
    return repaired.select(
        key,
        "species",
        "lat",
        "lon",
        "elevation_before",
        F.col("new_elevation").alias("elevation_after"),
        "slope_before",
        F.col("new_slope").alias("slope_after"),
        (F.col("new_elevation") - F.col("elevation_before")).alias("delta_elevation"),
        "corrected",
        "still_missing",
    )


def before_after(df: DataFrame, before: str, after: str, rows: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Five-number summary and mean of a column before and after, for the given rows."""
    phase = F.explode(
        F.array(F.struct(F.lit("before").alias("phase"), F.col(before).alias("value")), F.struct(F.lit("after").alias("phase"), F.col(after).alias("value")))
    )
    long = df.filter(rows).select(*keys, phase.alias("p")).select(*keys, "p.phase", "p.value")
    groups = [*keys, "phase"]
    q = exact_quantiles(long, groups, "value", {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0})
    m = long.groupBy(*groups).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        (F.count_if(F.col("value") > 80).cast("double") * 100.0 / F.count("value").cast("double")).alias("pct_over_80"),
    )
    return m.join(q, groups)  # two rows per group
