"""Background points: uniform, per species, effort-weighted; jitter and case weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitspark import settings as S
from habitspark.functions.geo import Grid
from habitspark.plans.scale import attach, hash_unit, running_totals, take_smallest


def sample_cells(area: DataFrame, keys: Sequence[str], n: int, seed: int = S.SEED, draw: Column | None = None) -> DataFrame:
    """``n`` cells per group without replacement, all of them when there are fewer.

    ``draw`` is a uniform value in [0, 1) per row; by default a hash of the cell, so a
    repeated run picks the same cells.
    """
    value = hash_unit(*[F.col(k) for k in keys], F.col("row"), F.col("col"), seed=seed) if draw is None else draw
    groups = list(keys)
    t = area.withColumn("_draw", value)
    if not groups:
        t = t.withColumn("_all", F.lit(0))
        groups = ["_all"]
    out = take_smallest(t, groups, "_draw", n, ["row", "col"])
    return out.drop("_draw", "_all")


def jitter(cells: DataFrame, grid: Grid, keys: Sequence[str] = (), seed: int = S.SEED, draws: tuple[Column, Column] | None = None) -> DataFrame:
    """Move cell centres by up to half a pixel in both directions.

    ``draws`` are uniform values in [0, 1) for longitude and latitude, by default hashes of the cell.
    """
    parts = [*[F.col(k) for k in keys], F.col("row"), F.col("col")]
    east, north = draws or (hash_unit(*parts, seed=seed + 1), hash_unit(*parts, seed=seed + 2))
    return cells.withColumns(
        {"lon": grid.lon_of(F.col("col")) + (east - 0.5) * grid.dx, "lat": grid.lat_of(F.col("row")) + (north - 0.5) * grid.dy}
    )


def effort(points: DataFrame, land: DataFrame, grid: Grid, alpha: int = 1) -> DataFrame:
    """Records of all species per land cell plus ``alpha``, and its share of the total."""
    placed = points.select(
        grid.clip_row(grid.row_of(F.col("lat"))).alias("row"), grid.clip_col(grid.col_of(F.col("lon"))).alias("col")
    )
    counts = placed.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))
    t = land.select("row", "col").join(counts, ["row", "col"], "left")
    t = t.select("row", "col", (F.coalesce("n", F.lit(0)) + alpha).alias("effort"), F.lit(1).alias("_one"))
    total = t.groupBy("_one").agg(F.sum("effort").alias("total"))
    joined = t.join(F.broadcast(total), "_one")  # a single row
    return joined.select("row", "col", "effort", (F.col("effort").cast("double") / F.col("total").cast("double")).alias("probability"))


def sample_by_effort(weighted: DataFrame, n: int, seed: int = S.SEED, draw: Column | None = None) -> DataFrame:
    """``n`` draws with replacement, proportional to the whole-number ``effort``, however few the cells.
    ``draw`` is a uniform value in [0, 1) from the number ``id`` of a draw, by default a hash of it.

    Cells become intervals of the running effort. Intervals and draws meet on a lattice
    over that range, so neither side is compared as a whole.
    """
    spark = weighted.sparkSession
    cells = weighted.select(
        "row", "col", "effort", F.lit(0).alias("_all"), F.struct("row", "col").alias("_at")
    )
    lines = running_totals(cells, ["_all"], "_at", ["effort"])
    facts = weighted.agg(F.count(F.lit(1)).alias("n"), F.sum("effort").alias("total")).first()
    if not facts["total"]:
        n = 0  # no effort, no draw
    step = max(1, -(-(facts["total"] or 0) // max(4096, facts["n"] // 1000)))
    intervals = lines.select(
        "row", "col", (F.col("cum_effort") - F.col("effort")).alias("lo"), F.col("cum_effort").alias("hi")
    )
    intervals = intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / step), F.floor((F.col("hi") - 1) / step))))
    draws = spark.range(n).select(
        F.col("id").alias("draw"), F.floor((hash_unit(F.col("id"), seed=seed) if draw is None else draw) * F.lit(float(facts["total"] or 0))).alias("u")
    )
    draws = draws.withColumn("_b", F.floor(F.col("u") / step))
    hit = (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))
    return draws.join(intervals, "_b").filter(hit).select("draw", "row", "col")


def case_weights(df: DataFrame, mode: str = "prevalencia", keys: Sequence[str] = ("species",), name: str = "weight") -> DataFrame:
    """Presence 1 and background n_presence / n_background, or 1 for every row."""
    if mode == "ninguno":
        return df.withColumn(name, F.lit(1.0))
    if mode != "prevalencia":
        raise ValueError(f"unknown weight mode: {mode}")
    y = F.col("presence")
    n = df.groupBy(*keys).agg(F.count_if(y == 1).alias("_p"), F.count_if(y == 0).alias("_b"))
    ratio = F.col("_p").cast("double") / F.greatest(F.col("_b"), F.lit(1)).cast("double")
    return attach(df, n, keys).withColumn(name, F.when(y == 0, ratio).otherwise(F.lit(1.0))).drop("_p", "_b")


# Background size and weighting per algorithm.
SCHEME = {
    "glm": {"n": S.N_BACKGROUND, "weights": "prevalencia"},
    "gam": {"n": S.N_BACKGROUND, "weights": "prevalencia"},
    "rf": {"n": S.N_BACKGROUND, "weights": "prevalencia"},
    "gbm": {"n": S.N_BACKGROUND, "weights": "prevalencia"},
    "maxent": {"n": S.N_BACKGROUND, "weights": "ninguno"},
}


def weights_per_algorithm(df: DataFrame, keys: Sequence[str] = ("species",)) -> DataFrame:
    out = case_weights(df, "prevalencia", keys, "_w")
    columns = [F.lit(1.0) if s["weights"] == "ninguno" else F.col("_w") for s in SCHEME.values()]
    return out.select("*", *[c.alias(f"weight_{a}") for a, c in zip(SCHEME, columns)]).drop("_w")


def presence_background(presences: DataFrame, background: DataFrame) -> DataFrame:
    return presences.withColumn("presence", F.lit(1)).unionByName(background.withColumn("presence", F.lit(0)), allowMissingColumns=True)
