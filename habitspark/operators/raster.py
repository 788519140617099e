"""Work on raster cells: sampling, alignment, masks, terrain, statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitspark import settings as S
from habitspark.functions import terrain as T
from habitspark.functions.geo import Grid, in_bbox
from habitspark.plans.scale import attach, exact_quantiles, join_hot, stored


def locate(points: DataFrame, grid: Grid) -> DataFrame:
    """Add the row and column of the pixel a point falls in."""
    return points.withColumns({"row": grid.row_of(F.col("lat")), "col": grid.col_of(F.col("lon"))})


def sample(points: DataFrame, layers: DataFrame, grid: Grid, bands: Sequence[str]) -> DataFrame:
    """Band values at points; null outside the grid and on no-data."""
    placed = locate(points, grid)
    return join_hot(placed, layers.select("row", "col", *bands), ["row", "col"], "left").drop("row", "col")


def sample_scaled(points: DataFrame, layer: DataFrame, grid: Grid, band: str) -> DataFrame:
    """Band at points with the index scaled over (n - 1) cells, as map legends use it.

    Points whose index leaves the grid are dropped.
    """
    x = (F.col("lon") - grid.x0) / (grid.max_x - grid.x0) * F.lit(grid.width - 1)
    y = (F.lit(grid.y0) - F.col("lat")) / (grid.y0 - grid.min_y) * F.lit(grid.height - 1)
    placed = points.withColumns({"row": y.cast("long"), "col": x.cast("long")})
    placed = placed.filter(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1))
    return join_hot(placed, layer.select("row", "col", band), ["row", "col"], "inner")


def override(points: DataFrame, patch: DataFrame, grid: Grid, bands: Sequence[str], bbox=S.PATCH_BBOX, keep_known: bool = False) -> DataFrame:
    """Replace bands inside a box by those of a finer layer, missing values included.

    ``keep_known`` keeps the old value where the finer layer has none.
    """
    inside = in_bbox(F.col("lon"), F.col("lat"), bbox)
    fresh = patch.select("row", "col", *[F.col(b).alias(f"_new_{b}") for b in bands])
    t = join_hot(locate(points, grid), fresh, ["row", "col"], "left")
    new = {b: F.coalesce(F.col(f"_new_{b}"), F.col(b)) if keep_known else F.col(f"_new_{b}") for b in bands}
    t = t.withColumns({b: F.when(inside, new[b]).otherwise(F.col(b)) for b in bands})
    return t.drop("row", "col", *[f"_new_{b}" for b in bands])


def apply_mask(layers: DataFrame, mask: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Null every band where the mask is not 1."""
    t = layers.join(mask.select("row", "col", "mask"), ["row", "col"], "left")
    return t.withColumns({b: F.when(F.col("mask") == 1, F.col(b)) for b in bands}).drop("mask")


def align_nearest(source: DataFrame, source_grid: Grid, target: DataFrame, band: str) -> DataFrame:
    """Value of the source pixel under each target cell centre."""
    t = target.select(
        "row", "col", source_grid.row_of(F.col("lat")).alias("_r"), source_grid.col_of(F.col("lon")).alias("_c")
    )
    s = source.select(F.col("row").alias("_r"), F.col("col").alias("_c"), band)
    return t.join(s, ["_r", "_c"], "left").select("row", "col", band)


def align_bilinear(source: DataFrame, source_grid: Grid, target: DataFrame, band: str) -> DataFrame:
    """Distance-weighted mean of the four surrounding source pixels that hold a value."""
    x = (F.col("lon") - source_grid.x0) / source_grid.dx - F.lit(0.5)
    y = (F.lit(source_grid.y0) - F.col("lat")) / source_grid.dy - F.lit(0.5)
    t = target.select("row", "col", F.floor(x).alias("c0"), (x - F.floor(x)).alias("fx"), F.floor(y).alias("r0"), (y - F.floor(y)).alias("fy"))
    near = F.explode(
        F.array(
            *[
                F.struct(
                    (F.col("r0") + dr).alias("r"),
                    (F.col("c0") + dc).alias("c"),
                    ((F.col("fy") if dr else 1.0 - F.col("fy")) * (F.col("fx") if dc else 1.0 - F.col("fx"))).alias("w"),
                )
                for dr in (0, 1)
                for dc in (0, 1)
            ]
        )
    )
    parts = t.select("row", "col", near.alias("p")).select("row", "col", F.col("p.r").alias("_r"), F.col("p.c").alias("_c"), F.col("p.w").alias("w"))
    s = source.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(band).cast("double").alias("v"))
    joined = parts.join(s, ["_r", "_c"], "left")
    weight = F.sum(F.when(F.col("v").isNotNull(), F.col("w")))
    return joined.groupBy("row", "col").agg(F.when(weight > 0, F.sum(F.col("w") * F.col("v")) / weight).alias(band))


def stack(bands: DataFrame, features: Sequence[str], available: Sequence[str], bbox=None) -> DataFrame:
    """One row per cell with the features in order; incomplete cells are left out."""
    missing = [f for f in features if f not in available]
    if missing:
        raise KeyError(f"layers without data: {missing}")
    if bbox is not None:
        bands = bands.filter(in_bbox(F.col("lon"), F.col("lat"), bbox))
    wide = bands.filter(F.col("band").isin(list(features))).groupBy("row", "col").pivot("band", list(features)).agg(F.first("value"))
    return wide.na.drop(subset=list(features)).select("row", "col", *features)


def _sources(index: str, last: int) -> Column:
    """Window positions a cell index fills: (target index, offset), edges repeated."""
    places = [
        (f"{index} + 1", -1, f"{index} < {last}"),
        (index, 0, "true"),
        (f"{index} - 1", 1, f"{index} > 0"),
        (index, -1, f"{index} = 0"),
        (index, 1, f"{index} = {last}"),
    ]
    items = ", ".join(f"named_struct('at', bigint({at}), 'd', {d}, 'ok', {ok})" for at, d, ok in places)
    return F.expr(f"filter(array({items}), p -> p.ok)")


OFFSETS = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]


def _z(dr: int, dc: int) -> str:
    return f"z{dr + 1}{dc + 1}"


def windows(cells: DataFrame, grid: Grid, value: str, only: DataFrame | None = None) -> DataFrame:
    """3x3 values around each cell as columns z00..z22.

    Every cell is sent to the windows it belongs to and combined there. Layers are stored
    clustered by row and column, so most of a window meets before the shuffle.
    """
    sent = (
        cells.select("row", "col", value)
        .withColumn("r", F.explode(_sources("row", grid.height - 1)))
        .withColumn("c", F.explode(_sources("col", grid.width - 1)))
        .select(F.col("r.at").alias("row"), F.col("c.at").alias("col"), F.col("r.d").alias("dr"), F.col("c.d").alias("dc"), value)
    )
    if only is not None:
        sent = sent.join(only.select("row", "col"), ["row", "col"], "left_semi")
    aggs = [F.expr(f"max({value}) FILTER (WHERE dr = {a} AND dc = {b}) AS {_z(a, b)}") for a, b in OFFSETS]
    return sent.groupBy("row", "col").agg(*aggs)


def _gradients(lat: Column, grid: Grid):
    return T.gradients({(a, b): F.col(_z(a, b)) for a, b in OFFSETS}, lat, grid.dx, grid.dy)


def terrain(cells: DataFrame, grid: Grid, warm_side: bool = False, elevation: str = "elevation") -> DataFrame:
    """Slope, aspect, northness and eastness of every cell of an elevation layer."""
    w = windows(cells, grid, elevation)
    lat = grid.lat_of(F.col("row"))
    gx, gy = _gradients(lat, grid)
    known = F.col(_z(0, 0)).isNotNull()
    g = w.select("row", "col", F.col(_z(0, 0)).alias("elevation"), lat.alias("lat"), F.when(known, gx).alias("gx"), F.when(known, gy).alias("gy"))
    a = g.select("row", "col", "elevation", "lat", T.slope_deg(F.col("gx"), F.col("gy")).alias("slope"), T.aspect_deg(F.col("gx"), F.col("gy")).alias("aspect"))
    return a.select(
        "row", "col", "elevation", "slope", "aspect",
        T.northness(F.col("aspect"), F.col("lat") if warm_side else None).alias("northness"),
        T.eastness(F.col("aspect")).alias("eastness"),
    )


def slope_at_points(points: DataFrame, cells: DataFrame, grid: Grid, old: str | None = None) -> DataFrame:
    """Slope at points only; an existing slope is kept as ``slope_before``."""
    placed = points.withColumns(
        {"row": grid.clip_row(grid.row_of(F.col("lat"))), "col": grid.clip_col(grid.col_of(F.col("lon")))}
    )
    needed = placed.select("row", "col").distinct()
    t = join_hot(placed, windows(cells, grid, "elevation", needed), ["row", "col"], "left")
    gx, gy = _gradients(F.col("lat"), grid)
    out = t.withColumn("_slope", F.when(F.col(_z(0, 0)).isNotNull(), T.slope_deg(gx, gy)))
    if old is not None:
        out = out.withColumnRenamed(old, "slope_before")
    return out.withColumnRenamed("_slope", "slope").drop("row", "col", *[_z(a, b) for a, b in OFFSETS])


def mosaic(layers: Sequence[DataFrame | None], value: str) -> DataFrame:
    """Combine overlapping layers by their mean; unavailable layers are skipped."""
    known = [layer.select("row", "col", value) for layer in layers if layer is not None]
    if not known:
        raise ValueError("no readable layer")
    out = known[0]
    for layer in known[1:]:
        out = out.unionByName(layer)
    return out.filter(F.col(value).isNotNull()).groupBy("row", "col").agg(F.avg(value).alias(value))


def to_iso3(df: DataFrame, country: str = "country", codes: Mapping[str, str] = S.ISO3) -> DataFrame:
    """Recode country names; rows of countries without a code are dropped."""
    table = F.create_map(*[x for k, v in codes.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn("iso3", F.element_at(table, F.col(country))).filter(F.col("iso3").isNotNull())


def binary_map(df: DataFrame, limits: DataFrame, keys: Sequence[str], value: str = "suitability") -> DataFrame:
    """1 where the value reaches a threshold, 0 below, null without data; per named threshold."""
    t = attach(df, limits, keys)
    return t.withColumn("suitable", (F.col(value).cast("float") >= F.col("threshold").cast("float")).cast("int"))


def statistics(df: DataFrame, keys: Sequence[str], value: str, steep: float = 80.0) -> DataFrame:
    """Range, median, display limits and the share of steep values."""
    v = stored(df.filter(F.col(value).isNotNull()).select(*keys, value))  # read by the range and by each quantile
    base = v.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        (F.count_if(F.col(value) > steep).cast("double") * 100.0 / F.count(F.lit(1)).cast("double")).alias("pct_steep"),
    )
    q = exact_quantiles(v, keys, value, {"median": 0.5, "p02": 0.02, "p98": 0.98})
    a = exact_quantiles(v.withColumn("_abs", F.abs(value)), keys, "_abs", {"abs_p98": 0.98})
    if not keys:
        one = F.lit(1).alias("_one")
        return base.select("*", one).join(q.select("*", one), "_one").join(a.select("*", one), "_one").drop("_one")
    return attach(attach(base, q, keys), a, keys)


def alignment(grids: DataFrame) -> DataFrame:
    """Compare the geometry of layers with the first one, at 8 decimals.

    ``grids(layer, position, width, height, x0, y0, dx, dy, crs)`` has one row per layer.
    """
    exact = ["width", "height", "crs"]
    close = ["x0", "y0", "dx", "dy"]
    first = grids.orderBy("position").limit(1).select(*[F.col(c).alias(f"r_{c}") for c in exact + close], F.lit(1).alias("_one"))
    t = grids.withColumn("_one", F.lit(1)).join(F.broadcast(first), "_one")  # a single row
    bad = [F.when(F.col(c) != F.col(f"r_{c}"), F.lit(c)) for c in exact]
    bad += [F.when(F.round(c, 8) != F.round(f"r_{c}", 8), F.lit(c)) for c in close]
    return t.select("layer", F.concat_ws(",", *bad).alias("mismatch")).withColumn("aligned", F.col("mismatch") == "")


def require_alignment(grids: DataFrame) -> None:
    wrong = [f"{r['layer']}: {r['mismatch']}" for r in alignment(grids).filter("NOT aligned").collect()]
    if wrong:
        raise ValueError("layers not aligned: " + "; ".join(wrong))


def cell_coverage(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells two layers share and those only one of them has."""
    left = a.select("row", "col", F.lit(1).alias("_a"))
    t = left.join(b.select("row", "col", F.lit(1).alias("_b")), ["row", "col"], "full_outer")
    return t.agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"),
        F.count_if(F.col("_b").isNull()).alias("n_first_only"),
        F.count_if(F.col("_a").isNull()).alias("n_second_only"),
    )
