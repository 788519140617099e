"""Column-level table shaping: naming, order, rounding, tags, lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from habitspark import settings as S
from habitspark.functions import text


def rename_predictors(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({code: name for code, name, _, _ in S.PREDICTOR_DICTIONARY})


def predictor_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(S.PREDICTOR_DICTIONARY, "code string, name string, description string, unit string")


def tag(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.select(F.lit(value).alias(name), "*")


def standard_first(df: DataFrame, standard: Mapping[str, str]) -> DataFrame:
    """Standard columns in order (null where absent), then everything else."""
    head = [F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in standard.items()]
    return df.select(*head, *[c for c in df.columns if c not in standard])


def round_numbers(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every floating column, exact halves to the even digit."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    scale = F.lit(float(10**digits))
    return df.withColumns({c: F.rint(F.col(c) * scale) / scale for c in doubles})


def records_of_slug(df: DataFrame, slugs: DataFrame, candidates: Sequence[str] = ("species", "especie", "scientific_name")) -> DataFrame:
    """Records whose slugged species name is listed; the name column is detected."""
    name = next((c for c in candidates if c in df.columns), None)
    if name is None:
        raise KeyError(f"no species column among {list(candidates)}")
    return df.withColumn("slug", text.slug(F.col(name))).join(slugs.select("slug"), "slug", "left_semi")
