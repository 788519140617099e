"""Joins by location: polygons, centroids, hulls, accessible area."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from habitspark import settings as S
from habitspark.functions.geo import Grid, geodesic_m, in_bbox
from habitspark.plans import proximity
from habitspark.plans.scale import attach, every_salt, join_hot, measured, salts

TILE_DEG = 0.5  # a power of two, so that borders of tiles are exact
TOUCH_DEG = 1e-9
DIRECTIONS = 32
INSIDE_DEG = 1e-9  # a point nearer to the ring than that is left to the exact hull


def _meets(y: Column, e) -> Column:
    """Does the edge cross this latitude? Half-open, so horizontal edges never do."""
    return (e["y1"] > y) != (e["y2"] > y)


def _x_at(y: Column, e) -> Column:
    return (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]


def _south_of(y: Column, x: Column, e) -> Column:
    """Does the edge, which has its ends on both sides of the meridian ``x``, pass it south of ``y``?

    Decided by the same crossing with ``y`` that the ray test looks at, so both agree to the last bit.
    """
    east_end_up = F.when(e["x2"] > x, e["y2"] > y).otherwise(e["y1"] > y)
    return F.when(_meets(y, e), (_x_at(y, e) > x) == east_end_up).otherwise(e["y1"] <= y)


def _changes(e) -> Column:
    """Does the edge part a point from the south-east corner of its tile?

    East of the point up to the border of the tile it is met by the ray to the east; from there to the
    corner it must pass the border between the point's latitude and the corner.
    """
    x, y = F.col("lon"), F.col("lat")
    border, corner = (F.col("_tx") + 1) * F.lit(TILE_DEG), F.col("_ty") * F.lit(TILE_DEG)
    at = _x_at(y, e)
    ray = _meets(y, e) & (x < at) & (at <= border)
    astride = (e["x1"] > border) != (e["x2"] > border)
    return ray != (astride & (_south_of(y, border, e) != _south_of(corner, border, e)))


def tile_index(edges: DataFrame) -> DataFrame:
    """Rows (feature_id, _tx, _ty) of closed rings: an edge that touches the tile, or nulls when the tile's south-east corner is inside.

    A tile wholly inside a feature has the latter row alone; tiles outside have none. Edges are repeated for the tiles they
    touch, found latitude band by latitude band, so a long edge costs its length and not its bounding box.
    """
    d = F.lit(TILE_DEG)
    e = {c: F.col(c) for c in ("x1", "y1", "x2", "y2")}
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    banded = edges.select("feature_id", *e).na.drop().withColumn("_ty", F.explode(F.sequence(F.floor(low / d), F.floor(high / d))))
    south, north = F.greatest(low, F.col("_ty") * d), F.least(high, (F.col("_ty") + 1) * d)
    level = F.col("y1") == F.col("y2")
    xa, xb = F.when(level, e["x1"]).otherwise(_x_at(south, e)), F.when(level, e["x2"]).otherwise(_x_at(north, e))
    # an edge on the eastern border belongs to the tile as well
    first, last = F.ceil((F.least(xa, xb) - TOUCH_DEG) / d) - 1, F.floor((F.greatest(xa, xb) + TOUCH_DEG) / d)
    touched = banded.withColumn("_tx", F.explode(F.sequence(first, last))).select("feature_id", "_tx", "_ty", *e)
    # tiles whose border lies west of a crossing with the corners' latitude; inside between every second pair of crossings
    corner = F.col("_ty") * d
    hits = banded.filter(_meets(corner, e)).select("feature_id", "_ty", (F.ceil(_x_at(corner, e) / d) - 2).alias("k"))
    ks = hits.groupBy("feature_id", "_ty").agg(F.array_sort(F.collect_list("k")).alias("k"))
    pairs = ks.withColumn("i", F.explode(F.sequence(F.lit(0), (F.size("k") / 2).cast("int") - 1)))
    ends = pairs.filter("i >= 0").select("feature_id", "_ty", F.get("k", F.col("i") * 2).alias("a"), F.get("k", F.col("i") * 2 + 1).alias("b"))
    inner = ends.filter("a < b").select("feature_id", F.explode(F.sequence(F.col("a") + 1, F.col("b"))).alias("_tx"), "_ty")
    return touched.unionByName(inner, allowMissingColumns=True)


def covering(points: DataFrame, edges: DataFrame, key: Sequence[str]) -> DataFrame:
    """Features that contain each point: ``key`` columns plus ``feature_id``.

    One row per input row and feature, whatever the keys. Rings must be closed. A point looks at the edges of its own tile
    only (``tile_index``). An index of checked size travels as one array per tile, so points are not shuffled. Beyond that its
    rows are salted and the parity is summed per distinct place, which then goes back to the rows.
    """
    index = tile_index(edges)
    d = F.lit(TILE_DEG)
    placed = points.select(*key, "lon", "lat", F.floor(F.col("lon") / d).alias("_tx"), F.floor(F.col("lat") / d).alias("_ty"))
    index, small = measured(index)
    sides = ("x1", "y1", "x2", "y2")
    if small:
        inside = F.max(F.col("x1").isNull()).alias("inside")
        per_feature = index.groupBy("_tx", "_ty", "feature_id").agg(inside, F.collect_list(F.when(F.col("x1").isNotNull(), F.struct(*sides))).alias("edges"))
        tiles = per_feature.groupBy("_tx", "_ty").agg(F.collect_list(F.struct("feature_id", "inside", "edges")).alias("features"))
        t = placed.join(F.broadcast(tiles), ["_tx", "_ty"])
        hit = F.filter("features", lambda f: f["inside"] != (F.size(F.filter(f["edges"], _changes)) % 2 == 1))
        return t.select(*key, F.explode(hit).alias("f")).select(*key, F.col("f.feature_id").alias("feature_id"))
    n = salts(points.sparkSession)
    places = placed.select("lon", "lat", "_tx", "_ty").distinct()
    spread = places.withColumn("_salt", F.pmod(F.xxhash64("lon", "lat"), F.lit(n)))
    repeated = index.withColumn("_salt", every_salt(n))
    met = spread.join(repeated, ["_tx", "_ty", "_salt"]).filter(F.col("x1").isNull() | _changes({c: F.col(c) for c in sides}))
    hits = met.groupBy("lon", "lat", "feature_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") % 2 == 1)
    at = hits.select(F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), "feature_id")
    return placed.join(at, (F.col("lon") == F.col("_lon")) & (F.col("lat") == F.col("_lat"))).select(*key, "feature_id")


def inside_any(points: DataFrame, edges: DataFrame, key: Sequence[str]) -> DataFrame:
    """Points inside at least one feature of the layer (the dissolved layer)."""
    hits = covering(points, edges, key).select(*key).distinct()
    return points.join(hits, list(key), "left_semi")


def keep_on_land(points: DataFrame, land: DataFrame | None, key: Sequence[str]) -> DataFrame:
    """Ocean filter; without a land layer the step does nothing."""
    return points if land is None else inside_any(points, land, key)


def polygon_centroids(edges: DataFrame, *attributes: str) -> DataFrame:
    """Area-weighted centroid in plain degrees."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    sums = edges.groupBy("feature_id", *attributes).agg(
        F.sum(cross).alias("a"), F.sum((F.col("x1") + F.col("x2")) * cross).alias("sx"), F.sum((F.col("y1") + F.col("y2")) * cross).alias("sy")
    )
    return sums.filter("a <> 0").select(
        "feature_id", *attributes, (F.col("sx") / (F.col("a") * 3.0)).alias("lon"), (F.col("sy") / (F.col("a") * 3.0)).alias("lat")
    )


def away_from_centroids(points: DataFrame, centroids: DataFrame | None, tolerance_km: float = S.CENTROID_TOLERANCE_KM) -> DataFrame:
    """Drop points within the tolerance of a centroid; without centroids do nothing.

    Distances are WGS-84 geodesics. Each centroid is entered in the lattice squares its circle can touch, also those
    beyond 180 degrees and around a pole, so a point looks at the centroids of its own square only. Longitudes are
    taken into [-180, 180). Points without a position stay.
    """
    if centroids is None:
        return points
    reach = tolerance_km / 110.0
    # a whole number of squares around the globe
    around = max(1, math.floor(360.0 / max(0.02, reach * 1.01)))
    step = 360.0 / around
    beyond = F.abs("c_lat") + reach
    wide = F.when(beyond >= 89.0, F.lit(180.0)).otherwise(F.lit(reach) / F.cos(F.radians(beyond)))
    c = centroids.select(F.col("lon").alias("c_lon"), F.col("lat").alias("c_lat")).filter("c_lon is not null and c_lat is not null")
    column = lambda lon: F.floor((lon + F.lit(180.0)) / step)
    first, last = column(F.col("c_lon") - wide), column(F.col("c_lon") + wide)
    xs = F.sequence(first, F.least(last, first + F.lit(around - 1)))
    ys = F.sequence(F.floor((F.col("c_lat") - reach) / step), F.floor((F.col("c_lat") + reach) / step))
    placed = c.withColumn("_x", F.explode(xs)).withColumn("_x", F.pmod("_x", F.lit(around))).withColumn("_y", F.explode(ys))
    near = placed.groupBy("_x", "_y").agg(F.collect_list(F.struct("c_lon", "c_lat")).alias("_near"))
    t = points.withColumns({"_x": F.pmod(column(F.col("lon")), F.lit(around)), "_y": F.floor(F.col("lat") / step)})
    t = attach(t, near, ["_x", "_y"], "left")
    close = F.exists("_near", lambda p: geodesic_m(F.col("lon"), F.col("lat"), p["c_lon"], p["c_lat"]) <= tolerance_km * 1000.0)
    return t.filter(~F.coalesce(close, F.lit(False))).drop("_x", "_y", "_near")


def touched_cells(edges: DataFrame, grid: Grid) -> DataFrame:
    """Cells an edge passes through, row by row along the edge."""
    e = edges.filter("x1 IS NOT NULL AND x2 IS NOT NULL").select(
        "x1", "y1", "x2", "y2", F.least("y1", "y2").alias("lo"), F.greatest("y1", "y2").alias("hi")
    )
    rows = F.sequence(
        F.greatest(grid.row_of(F.col("hi")), F.lit(0)), F.least(grid.row_of(F.col("lo")), F.lit(grid.height - 1)), F.lit(1).cast("bigint")
    )
    overlaps = (grid.row_of(F.col("hi")) <= grid.height - 1) & (grid.row_of(F.col("lo")) >= 0)
    r = e.filter(overlaps).withColumn("row", F.explode(rows))
    top = F.lit(grid.y0) - F.col("row") * grid.dy
    bottom = F.lit(grid.y0) - (F.col("row") + 1) * grid.dy

    def x_at(y: Column) -> Column:
        slope = (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
        return F.col("x1") + (y - F.col("y1")) * slope

    level = F.col("y1") == F.col("y2")
    xa = F.when(level, F.col("x1")).otherwise(x_at(F.greatest(F.col("lo"), bottom)))
    xb = F.when(level, F.col("x2")).otherwise(x_at(F.least(F.col("hi"), top)))
    spans = r.select("row", F.least(xa, xb).alias("xa"), F.greatest(xa, xb).alias("xb"))
    c0, c1 = F.greatest(grid.col_of(F.col("xa")), F.lit(0)), F.least(grid.col_of(F.col("xb")), F.lit(grid.width - 1))
    return spans.filter(c0 <= c1).select("row", F.explode(F.sequence(c0, c1)).alias("col")).distinct()


def land_mask(cells: DataFrame, edges: DataFrame, grid: Grid) -> DataFrame:
    """1 where a polygon covers the cell centre or touches the cell, else 0."""
    centres = covering(cells, edges, ["row", "col"]).select("row", "col")
    marked = centres.unionByName(touched_cells(edges, grid)).distinct().withColumn("mask", F.lit(1))
    t = cells.select("row", "col").join(marked, ["row", "col"], "left")
    return t.withColumn("mask", F.coalesce("mask", F.lit(0)))


def calibration_cells(land: DataFrame, edges: DataFrame | None, country: str, name_columns: Sequence[str], bbox=S.CALIBRATION_BBOX) -> DataFrame:
    """Land cells of a country; its box when the polygon is unknown, all land when empty."""
    area = None
    if edges is not None:
        for c in [c for c in name_columns if c in edges.columns]:
            match = edges.filter(F.col(c) == country)
            if not match.isEmpty():
                area = inside_any(land, match, ["row", "col"])
                break
    if area is None:
        area = land.filter(in_bbox(F.col("lon"), F.col("lat"), bbox))
    return land if area.isEmpty() else area


def presences_in(points: DataFrame, area: DataFrame, grid: Grid) -> DataFrame:
    """Presences whose pixel, clipped to the grid, belongs to the calibration area."""
    placed = points.withColumns(
        {"row": grid.clip_row(grid.row_of(F.col("lat"))), "col": grid.clip_col(grid.col_of(F.col("lon")))}
    )
    marked = area.select("row", "col").distinct().withColumn("_in", F.lit(True))
    return join_hot(placed, marked, ["row", "col"], "inner").drop("row", "col", "_in")


def accessible_cells(points: DataFrame, land: DataFrame, keys: Sequence[str] = ("species",), radius_km: float = S.ACCESSIBLE_KM) -> DataFrame:
    return proximity.within(points, land, keys, radius_km)


def require_area(area: DataFrame) -> DataFrame:
    if area.isEmpty():
        raise ValueError("empty accessible area: no land cell within the radius")
    return area


def nearest_presence(points: DataFrame, cells: DataFrame, keys: Sequence[str] = ("species",), radius_km: float = S.ACCESSIBLE_KM) -> DataFrame:
    return proximity.nearest(points, cells, keys, radius_km)


def _turn_hull(xy: np.ndarray) -> np.ndarray:
    """Hull vertices of distinct points, counter-clockwise, collinear points left out."""
    xy = np.unique(xy, axis=0)
    if len(xy) < 3:
        return xy

    def half(points: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in points:
            while len(out) > 1:
                u, v = out[-1] - out[-2], p - out[-2]
                # coordinates are decimal fractions: straight lines are straight up to rounding
                if u[0] * v[1] - u[1] * v[0] > 1e-12 * np.hypot(*u) * np.hypot(*v):
                    break
                out.pop()
            out.append(p)
        return out

    lower, upper = half(xy), half(xy[::-1])
    return np.array(lower[:-1] + upper[:-1])


def outer_points(points: DataFrame, key: str = "species") -> DataFrame:
    """Points of each group without those that surely lie inside its hull.

    Plain aggregates find the farthest point in ``DIRECTIONS`` directions; what lies clearly inside the ring of these points
    cannot be a vertex. The ring is one row per group. Points on its edges, and groups of fewer than three such points, stay.
    """
    rows = points.select(key, "lon", "lat").na.drop()
    turns = [2 * math.pi * i / DIRECTIONS for i in range(DIRECTIONS)]
    along = [F.col("lon") * F.lit(math.cos(a)) + F.col("lat") * F.lit(math.sin(a)) for a in turns]
    far = [F.max_by(c, d).alias(f"{c}{i}") for i, d in enumerate(along) for c in ("lon", "lat")]
    ends = [(i, (i + 1) % DIRECTIONS) for i in range(DIRECTIONS)]
    edges = F.array(*[F.struct(*[F.col(f"{c}{i}").alias(f"{a}{n}") for n, i in ((1, i), (2, j)) for a, c in (("x", "lon"), ("y", "lat"))]) for i, j in ends])
    long_enough = F.filter(edges, lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))
    ring = rows.groupBy(key).agg(*far).select(key, long_enough.alias("_edges"))

    def inside(e) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        return dx * (F.col("lat") - e["y1"]) - dy * (F.col("lon") - e["x1"]) > F.sqrt(dx * dx + dy * dy) * INSIDE_DEG

    held = attach(rows, ring, [key])
    return held.filter(~((F.size("_edges") >= 3) & F.forall("_edges", inside))).drop("_edges")


def convex_hull(points: DataFrame, key: str = "species") -> DataFrame:
    """Hull vertices per group in order (``seq``).

    Inner points are dropped by column expressions (``outer_points``). Each partition reduces what is left to hulls before
    anything is shuffled; the hull of those vertices is the hull of all points.
    """
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, part in batch.groupby(key):
                xy = part[["lon", "lat"]].to_numpy()
                kept[name] = _turn_hull(np.vstack([kept[name], xy]) if name in kept else xy)
        for name, xy in kept.items():
            yield pd.DataFrame({key: name, "lon": xy[:, 0], "lat": xy[:, 1]})

    def finish(part: pd.DataFrame) -> pd.DataFrame:
        xy = _turn_hull(part[["lon", "lat"]].to_numpy())
        return pd.DataFrame({key: part[key].iloc[0], "seq": np.arange(len(xy), dtype="int32"), "lon": xy[:, 0], "lat": xy[:, 1]})

    vertices = outer_points(points, key).mapInPandas(reduce, schema)
    return vertices.groupBy(key).applyInPandas(finish, f"{key} string, seq int, lon double, lat double")


def cells_in_hull(hull: DataFrame, cells: DataFrame, grid: Grid, key: str = "species") -> DataFrame:
    """Cells (key, row, col) whose centre lies in the hull; fewer than three vertices hold none."""
    ring = hull.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))).alias("v"))
    ring = ring.filter(F.size("v") >= 3).select(
        key,
        F.transform(
            "v",
            lambda p, i: F.struct(
                p["lon"].alias("x1"), p["lat"].alias("y1"),
                F.element_at("v", (F.pmod(i + 1, F.size("v")) + 1).cast("int"))["lon"].alias("x2"),
                F.element_at("v", (F.pmod(i + 1, F.size("v")) + 1).cast("int"))["lat"].alias("y2"),
            ),
        ).alias("edges"),
    )
    south, north = F.array_min(F.transform("edges", lambda e: e["y1"])), F.array_max(F.transform("edges", lambda e: e["y1"]))
    west, east = F.array_min(F.transform("edges", lambda e: e["x1"])), F.array_max(F.transform("edges", lambda e: e["x1"]))
    first, last = grid.clip_row(grid.row_of(north)), grid.clip_row(grid.row_of(south))
    rows = ring.select(key, "edges", west.alias("w"), east.alias("e"), F.explode(F.sequence(first, last)).alias("row"))
    lat = grid.lat_of(F.col("row"))

    def x_on_row(e) -> Column:
        hit = (F.least(e["y1"], e["y2"]) <= lat) & (lat <= F.greatest(e["y1"], e["y2"])) & (e["y1"] != e["y2"])
        return F.when(hit, e["x1"] + (lat - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"]))

    xs = rows.withColumn("xs", F.filter(F.transform("edges", x_on_row), lambda x: x.isNotNull())).filter(F.size("xs") > 0)
    # one more column on either side, then the exact test
    c0 = grid.clip_col(grid.col_of(F.array_min("xs")) - 1)
    c1 = grid.clip_col(grid.col_of(F.array_max("xs")) + 1)
    candidates = xs.select(key, "edges", "row", F.explode(F.sequence(c0, c1)).alias("col"))
    lon = grid.lon_of(F.col("col"))

    def left_of(e) -> Column:
        return (e["x2"] - e["x1"]) * (lat - e["y1"]) - (e["y2"] - e["y1"]) * (lon - e["x1"]) >= 0

    found = candidates.filter(F.forall("edges", left_of)).select(key, "row", "col")
    return found.join(cells.select("row", "col"), ["row", "col"], "left_semi").select(key, "row", "col")


def range_map(points: DataFrame, cells: DataFrame, grid: Grid, decay_km: float = S.EOO_DECAY_KM, radius_km: float = S.EOO_RADIUS_KM) -> DataFrame:
    """Range suitability: 1 inside the hull, Gaussian decay with distance outside.

    Cells beyond the radius have suitability zero and are not listed.
    """
    inside = cells_in_hull(convex_hull(points), cells, grid).withColumn("_in", F.lit(True))
    d = proximity.nearest(points, cells, ["species"], radius_km)
    t = d.join(inside, ["species", "row", "col"], "full_outer")
    q = F.col("distance_km") / F.lit(decay_km)
    return t.select("species", "row", "col", F.when(F.col("_in"), F.lit(1.0)).otherwise(F.exp(-(q * q))).alias("suitability"))

