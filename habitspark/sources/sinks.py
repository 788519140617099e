"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitspark.functions import text
from habitspark.plans.scale import scratch_folder


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet_once(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Keep an existing output unless it is to be replaced."""
    df.write.mode("overwrite" if overwrite else "ignore").parquet(path)


def split_by_species(df: DataFrame, path: str, branch: str | None = None, species: list[str] | None = None) -> DataFrame:
    """Write one folder per species in a single pass and return the record counts.

    Rows are dealt by species first, so a task writes few folders; adaptive execution splits a species of very many rows.
    """
    out = df if species is None else df.filter(F.col("species").isin(species))
    if branch is not None:
        out = out.select(F.lit(branch).alias("branch"), "*")
    out = out.withColumn("species_slug", text.slug(F.col("species")))
    out.hint("rebalance", "species_slug").write.mode("overwrite").partitionBy("species_slug").parquet(path)
    written = out.sparkSession.read.parquet(path)
    return written.groupBy("species_slug").agg(F.count(F.lit(1)).alias("n_records"))


def quarantine(df: DataFrame, burn: Column, kept_path: str, burned_path: str) -> None:
    """Split on one predicate into two new tables; the input stays untouched."""
    flagged = df.withColumn("_burn", F.coalesce(burn, F.lit(False)))
    flagged.filter(~F.col("_burn")).drop("_burn").write.mode("overwrite").parquet(kept_path)
    flagged.filter("_burn").drop("_burn").write.mode("overwrite").parquet(burned_path)
