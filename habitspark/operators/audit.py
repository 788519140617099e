"""Quality reports over the base table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitspark import settings as S
from habitspark.functions.geo import in_bbox


def quality(df: DataFrame, predictors: Sequence[str], bbox=S.PREDICTION_BBOX, min_records: int = S.MIN_RECORDS) -> DataFrame:
    """One row of counts over the base table.

    Checks on columns the table does not have are left out.
    """
    have = set(df.columns)
    incomplete: Column = F.lit(False)
    for p in predictors:
        incomplete = incomplete | F.col(p).isNull()
    aggs = [
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~in_bbox(F.col("lon"), F.col("lat"), bbox)).alias("n_outside"),
        F.count_if(F.col("lon").isNull() | F.col("lat").isNull()).alias("n_null_coords"),
        F.count_if(incomplete).alias("n_incomplete"),
    ]
    if "elevation" in have:
        aggs += [
            F.count_if(F.col("elevation") < 0).alias("n_elevation_negative"),
            F.min("elevation").alias("elevation_min"),
            F.max("elevation").alias("elevation_max"),
        ]
    if "slope" in have:
        aggs.append(F.count_if(~F.col("slope").between(0, 90)).alias("n_slope_out"))
    if {"northness", "eastness"} <= have:
        aggs.append(F.count_if((F.abs("northness") > 1) | (F.abs("eastness") > 1)).alias("n_exposure_out"))
    if set(S.TERRAIN) <= have:
        zero = F.lit(True)
        for c in S.TERRAIN:
            zero = zero & (F.col(c) == 0)
        aggs.append(F.count_if(zero).alias("n_flat_zero"))
    if "bio12" in have:
        aggs.append(F.count_if(F.col("bio12") < 0).alias("n_rain_negative"))
    if {"bio5", "bio6", "bio7"} <= have:
        aggs.append(F.count_if(F.abs(F.col("bio7") - (F.col("bio5") - F.col("bio6"))) > 1e-6).alias("n_range_mismatch"))
        aggs.append(F.count_if(F.col("bio5") < F.col("bio6")).alias("n_max_below_min"))
    if "year" in have:
        aggs += [F.min("year").alias("year_min"), F.max("year").alias("year_max"), F.count_if(F.col("year").isNull()).alias("n_no_year")]
    base = df.agg(*aggs).withColumn("n_columns", F.lit(len(df.columns)))
    # repeated records and species totals come from their own combined counts
    repeats = df.groupBy("species", "lat", "lon").agg(F.count(F.lit(1)).alias("n"))
    repeats = repeats.agg(F.sum(F.col("n") - 1).alias("n_duplicates"))
    species = df.groupBy("species").agg(F.count(F.lit(1)).alias("n"))
    species = species.agg(F.count(F.lit(1)).alias("n_species"), F.count_if(F.col("n") >= min_records).alias("n_viable"))
    one = F.lit(1).alias("_one")
    # three single rows
    out = base.select("*", one).join(repeats.select("*", one), "_one").join(species.select("*", one), "_one")
    return out.drop("_one")


def null_counts(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns])


def extent(df: DataFrame, margin: float = 1.0) -> DataFrame:
    return df.agg(
        (F.min("lon") - margin).alias("min_lon"), (F.min("lat") - margin).alias("min_lat"),
        (F.max("lon") + margin).alias("max_lon"), (F.max("lat") + margin).alias("max_lat"),
    )


def fold_balance(df: DataFrame, groups: Sequence[str] = ("species",), fold: str = "cv_fold") -> DataFrame:
    return df.groupBy(*groups, fold).agg(F.sum(F.col("presence").cast("long")).alias("n_presence"), F.count(F.lit(1)).alias("n"))


def folds_with_presence(balance: DataFrame, groups: Sequence[str] = ("species",)) -> DataFrame:
    return balance.groupBy(*groups).agg(F.count_if(F.col("n_presence") > 0).alias("folds_with_presence"), F.count(F.lit(1)).alias("n_folds"))
