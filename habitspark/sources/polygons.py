"""Polygon layers as vertex tables (feature_id, ring_id, seq, lon, lat, attributes)."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

log = logging.getLogger(__name__)


def read_polygons(spark: SparkSession, path: str) -> DataFrame | None:
    """Vertex table, or None when the layer is unavailable: the step using it is skipped."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        log.warning("polygon layer not found at %s", path)
        return None


def edges(vertices: DataFrame, *attributes: str) -> DataFrame:
    """One row per ring segment; ``seq`` counts up by one along a closed ring.

    Each vertex meets its successor by key, so a very long ring is not one task.
    """
    start = vertices.select("feature_id", "ring_id", "seq", *attributes, F.col("lon").alias("x1"), F.col("lat").alias("y1"))
    end = vertices.select("feature_id", "ring_id", (F.col("seq") - 1).alias("seq"), F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    return start.join(end, ["feature_id", "ring_id", "seq"]).drop("ring_id", "seq")
