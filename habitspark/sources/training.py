"""Modelling tables: predictors per record, out-of-fold scores, available species."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from habitspark import settings as S
from habitspark.functions import text


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return df


def read_training(
    spark: SparkSession, path: str, species_slug: str | None = None, chosen: DataFrame | None = None
) -> tuple[DataFrame, list[str]]:
    """Dataset of one species (or all) and its predictor list.

    ``chosen(species_slug, predictor, position)`` is the selection table; without an
    entry the full predictor list applies.
    """
    df = spark.read.parquet(path)
    predictors = [p for p in S.PREDICTORS if p in df.columns]
    if species_slug is not None:
        df = df.filter(F.col("species_slug") == species_slug)
        if chosen is not None:
            # at most one row per predictor column
            rows = chosen.filter(F.col("species_slug") == species_slug).orderBy("position").collect()
            predictors = [r["predictor"] for r in rows] or predictors
    return require_columns(df, ["presence", *predictors]), predictors


def read_oof(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def discover_species(datasets: DataFrame, chosen: DataFrame) -> DataFrame:
    """Species with a dataset and a predictor list, with their display name."""
    found = datasets.select("species_slug").distinct().join(chosen.select("species_slug").distinct(), "species_slug", "left_semi")
    return found.select("species_slug", text.unslug(F.col("species_slug")).alias("species"))
