"""Present and future suitability: spread over scenarios, change, area tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitspark.functions.geo import Grid, constant_pixel_km2, pixel_km2
from habitspark.plans.scale import attach

THRESHOLD_NAMES = ["maxTSS", "p10", "min_train"]


def over_scenarios(df: DataFrame, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Mean and population spread across scenarios per cell, nulls left out."""
    return df.groupBy(*keys).agg(
        F.avg("suitability").alias("future_mean"), F.stddev_pop("suitability").alias("future_sd"), F.count("suitability").alias("n_scenarios")
    )


def change(future: DataFrame, present: DataFrame, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Future mean minus present; null when either is missing."""
    return present.join(future, list(keys), "full_outer").withColumn("delta", F.col("future_mean") - F.col("suitability"))


def named_limits(limits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, threshold_name, threshold) from columns named after the thresholds."""
    names = [n for n in THRESHOLD_NAMES if n in limits.columns]
    return limits.unpivot(list(keys), names, "threshold_name", "threshold").filter(F.col("threshold").isNotNull())


def area_table(maps: DataFrame, limits: DataFrame, keys: Sequence[str], grid: Grid | None = None, present: str = "presente") -> DataFrame:
    """Suitable area per scenario and threshold, with the change against the present.

    ``maps`` has keys, scenario, lat and suitability; ``limits`` keys, threshold_name and
    threshold. Without a grid every pixel counts as the equatorial one, with a grid by
    its true area.
    """
    t = attach(maps, limits, keys)
    area = F.lit(constant_pixel_km2()) if grid is None else pixel_km2(F.col("lat"), grid)
    # maps are stored in single precision, so the threshold is compared in it too
    hit = F.col("suitability").cast("float") >= F.col("threshold").cast("float")
    if grid is None:
        total = F.count_if(hit).cast("double") * area
    else:
        total = F.coalesce(F.sum(F.when(hit, area)), F.lit(0.0))
    groups = [*keys, "threshold_name", "threshold"]
    areas = t.groupBy(*groups, "scenario").agg(total.alias("area"))
    now = areas.filter(F.col("scenario") == present).select(*groups, F.col("area").alias("area_now"))
    both = areas.join(now, groups)  # one row per species, scenario and threshold
    return both.select(
        *keys,
        "scenario",
        "threshold_name",
        F.round("threshold", 4).alias("threshold"),
        F.round("area", 1).alias("area_km2"),
        F.round(F.col("area") - F.col("area_now"), 1).alias("delta_km2"),
    )


def merge_area_tables(scenarios: DataFrame, mean_table: DataFrame, present: str = "presente") -> DataFrame:
    """Append the table of the scenario mean without repeating the present rows."""
    return scenarios.unionByName(mean_table.filter(F.col("scenario") != present))
