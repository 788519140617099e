"""Raster layers as cell tables: (row, col, value) per layer or one column per band."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from habitspark import settings as S

log = logging.getLogger(__name__)


def valid_value(value: Column, nodata: float | None = S.RASTER_NODATA) -> Column:
    """Null for the declared no-data value, NaN and the huge negative fill of some files."""
    ok = ~F.isnan(value) & (value >= -1e10)
    if nodata is not None:
        ok = ok & (value != nodata)
    return F.when(ok, value)


def read_layer(layer: DataFrame, name: str, nodata: float | None = S.RASTER_NODATA) -> DataFrame:
    return layer.select("row", "col", valid_value(F.col("value"), nodata).cast("float").alias(name))


def read_layers(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    """Layers by name; a path that cannot be read is reported and left out."""
    found: dict[str, DataFrame] = {}
    for name, path in paths.items():
        try:
            found[name] = read_layer(spark.read.parquet(path), name)
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
            log.warning("layer %s not found at %s, skipped", name, path)
    return found


def select_bands(bands: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Pick bands of a multi-band raster; ``names`` maps band id to variable."""
    wanted = bands.filter(F.col("band").isin(list(names)))
    wide = wanted.groupBy("row", "col").pivot("band", list(names)).agg(F.first("value"))
    return wide.withColumnsRenamed(dict(names))


def full_grid(cells: DataFrame, values: DataFrame, keys: Iterable[str] = ("row", "col"), nodata: float | None = None) -> DataFrame:
    """Put values of valid cells back on the whole grid."""
    out = cells.select("row", "col").join(values, list(keys), "left")
    if nodata is None:
        return out
    filled = [c for c in values.columns if c not in set(keys)]
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(nodata)) for c in filled})


def write_layer(df: DataFrame, path: str, partitions: Iterable[str] = ()) -> None:
    """Write cells clustered by row, so that readers prune on the bounding box."""
    out = df.repartitionByRange("row", "col").sortWithinPartitions("row", "col")
    out.write.mode("overwrite").partitionBy(*partitions).parquet(path)
