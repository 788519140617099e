"""Raster cells: sampling, alignment, masks, terrain, scenarios, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from habitspark import settings as S
from habitspark.functions.geo import Grid, constant_pixel_km2
from habitspark.operators import audit as A
from habitspark.operators import raster as R
from habitspark.operators import repair as RP
from habitspark.operators import scenarios as SC
from habitspark.suite import views as V
from habitspark.suite.metrics import rounded
from habitspark.suite.registry import query
from habitspark.suite.views import with_views

PATCH = (-72.0, -40.0, -50.0, 0.0)
PATCH_SQL = "lon BETWEEN -72.0 AND -50.0 AND lat BETWEEN -40.0 AND 0.0"
OFF = ", ".join(f"({a}, {b})" for a, b in R.OFFSETS)
WIN = (
    "win AS (SELECT t.row, t.col, max(t.lat) AS lat, max(dx) AS dx, max(dy) AS dy, "
    + ", ".join(f"max(CASE WHEN dr = {a} AND dc = {b} THEN s.elevation END) AS z{a + 1}{b + 1}" for a, b in R.OFFSETS)
    + f""" FROM cells t CROSS JOIN grid CROSS JOIN (VALUES {OFF}) AS o(dr, dc)
  JOIN cells s ON s.row = least(greatest(t.row + dr, 0), h - 1) AND s.col = least(greatest(t.col + dc, 0), w - 1) GROUP BY 1, 2)"""
)


def horn(lat: str) -> str:
    z = {(a, b): f"coalesce(z{a + 1}{b + 1}, z11)" for a, b in R.OFFSETS}
    east = f"({z[-1, 1]} + 2 * {z[0, 1]} + {z[1, 1]})"
    west = f"({z[-1, -1]} + 2 * {z[0, -1]} + {z[1, -1]})"
    south = f"({z[1, -1]} + 2 * {z[1, 0]} + {z[1, 1]})"
    north = f"({z[-1, -1]} + 2 * {z[-1, 0]} + {z[-1, 1]})"
    return f"({east} - {west}) / (8 * dx * 111320 * cos(radians({lat}))) AS gx, ({south} - {north}) / (8 * dy * 111320) AS gy"


GRAD = f"grad AS (SELECT row, col, lat, z11 AS elevation, {horn('lat')} FROM win WHERE z11 IS NOT NULL UNION ALL SELECT row, col, lat, NULL, NULL, NULL FROM win WHERE z11 IS NULL)"
TERRAIN = """angles AS (SELECT *, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope, CASE WHEN gx <> 0 OR gy <> 0 THEN
  CASE WHEN degrees(atan2(gy, -gx)) < 0 THEN 90 - degrees(atan2(gy, -gx)) WHEN degrees(atan2(gy, -gx)) > 90
  THEN 450 - degrees(atan2(gy, -gx)) ELSE 90 - degrees(atan2(gy, -gx)) END END AS aspect FROM grad),
terrain AS (SELECT *, coalesce(cos(radians(aspect)), 0) AS northness, coalesce(sin(radians(aspect)), 0) AS eastness FROM angles)"""
TERRAIN_VIEWS = [V.CELLS, WIN, GRAD, TERRAIN]


@query("f_horn_slope", with_views(TERRAIN_VIEWS, "SELECT row, col, round(slope, 6) AS slope FROM terrain"))
def f_horn_slope(spark, d):
    return rounded(R.terrain(V.cells(spark, d), V.grid(spark, d)).select("row", "col", "slope"))


@query("f_horn_aspect", with_views(TERRAIN_VIEWS, "SELECT row, col, round(aspect, 6) AS aspect FROM terrain"))
def f_horn_aspect(spark, d):
    return rounded(R.terrain(V.cells(spark, d), V.grid(spark, d)).select("row", "col", "aspect"))


@query(
    "f_aspect_components",
    with_views(TERRAIN_VIEWS, "SELECT row, col, round(northness * CASE WHEN lat < 0 THEN -1 ELSE 1 END, 6) + 0 AS northness, round(eastness, 6) AS eastness FROM terrain"),
)
def f_aspect_components(spark, d):
    t = R.terrain(V.cells(spark, d), V.grid(spark, d), warm_side=True).select("row", "col", "northness", "eastness")
    return rounded(t).withColumn("northness", F.col("northness") + 0.0)


@query(
    "f_terrain_pipeline",
    with_views(TERRAIN_VIEWS, f"SELECT row, col, elevation, round(slope, 6) AS slope, round(northness, 6) AS northness, round(eastness, 6) AS eastness FROM terrain WHERE {PATCH_SQL.replace('lon', '(SELECT x0 + (col + CAST(0.5 AS DOUBLE)) * dx FROM grid)')}"),
)
def f_terrain_pipeline(spark, d):
    g = V.grid(spark, d)
    t = R.terrain(V.cells(spark, d), g)
    clipped = t.filter(g.lon_of(F.col("col")).between(PATCH[0], PATCH[2]) & g.lat_of(F.col("row")).between(PATCH[1], PATCH[3]))
    return rounded(clipped.select("row", "col", "elevation", "slope", "northness", "eastness"), "elevation")


@query(
    "f_horn_at_points",
    with_views(
        [V.OCC, V.CELLS, WIN],
        f"""SELECT rec_id, slope_before, round(CASE WHEN z11 IS NOT NULL THEN degrees(atan(sqrt(gx * gx + gy * gy))) END, 6) AS slope FROM (
        SELECT rec_id, uncertainty_m AS slope_before, z11, {horn('plat')} FROM (SELECT o.rec_id, o.uncertainty_m, o.lat AS plat,
        CAST(least(greatest(floor((o.lon - x0) / dx), 0), w - 1) AS BIGINT) AS col,
        CAST(least(greatest(floor((y0 - o.lat) / dy), 0), h - 1) AS BIGINT) AS row FROM occ o, grid) JOIN win USING (row, col))""",
    ),
)
def f_horn_at_points(spark, d):
    pts = V.occ(spark, d).select("rec_id", "lon", "lat", F.col("uncertainty_m").alias("slope"))
    out = R.slope_at_points(pts, V.cells(spark, d), V.grid(spark, d), old="slope")
    return rounded(out.select("rec_id", "slope_before", "slope"), "slope_before")


@query("jn_sample_points", with_views([V.ENV], "SELECT rec_id, elevation, b1, b2, b3 FROM env"))
def jn_sample_points(spark, d):
    return V.env(spark, d).select("rec_id", "elevation", "b1", "b2", "b3")


@query(
    "jn_override_patch",
    with_views([V.ENV], f"SELECT rec_id, CASE WHEN {PATCH_SQL} THEN b1 ELSE elevation END AS elevation FROM env"),
)
def jn_override_patch(spark, d):
    g = V.grid(spark, d)
    pts = R.sample(V.occ(spark, d).select("rec_id", "lon", "lat"), V.cells(spark, d), g, ["elevation"])
    patch = V.bands_wide(spark, d).select("row", "col", F.col("b1").alias("elevation"))
    return R.override(pts, patch, g, ["elevation"], PATCH).select("rec_id", "elevation")


@query(
    "jn_override_patch_keep",
    with_views([V.ENV], f"SELECT rec_id, CASE WHEN {PATCH_SQL} THEN coalesce(b1, elevation) ELSE elevation END AS elevation FROM env"),
)
def jn_override_patch_keep(spark, d):
    g = V.grid(spark, d)
    pts = R.sample(V.occ(spark, d).select("rec_id", "lon", "lat"), V.cells(spark, d), g, ["elevation"])
    patch = V.bands_wide(spark, d).select("row", "col", F.col("b1").alias("elevation"))
    return R.override(pts, patch, g, ["elevation"], PATCH, keep_known=True).select("rec_id", "elevation")


@query(
    "jn_apply_mask",
    with_views([V.CELLS, V.BANDS_WIDE], "SELECT row, col, CASE WHEN land THEN b1 END AS b1, CASE WHEN land THEN b2 END AS b2 FROM bands_wide JOIN cells USING (row, col)"),
)
def jn_apply_mask(spark, d):
    mask = V.cells(spark, d).select("row", "col", F.col("land").cast("int").alias("mask"))
    return R.apply_mask(V.bands_wide(spark, d).select("row", "col", "b1", "b2"), mask, ["b1", "b2"])


TARGET = """target AS (SELECT row, col, (x0 + CAST(0.3 AS DOUBLE) * dx) + (col + CAST(0.5 AS DOUBLE)) * (dx * CAST(0.9 AS DOUBLE)) AS lon,
  (y0 - CAST(0.2 AS DOUBLE) * dy) - (row + CAST(0.5 AS DOUBLE)) * (dy * CAST(0.9 AS DOUBLE)) AS lat FROM cells, grid)"""


def target_cells(spark, d):
    g = V.grid(spark, d)
    t = Grid(g.x0 + 0.3 * g.dx, g.y0 - 0.2 * g.dy, g.dx * 0.9, g.dy * 0.9, g.width, g.height)
    c = V.cells(spark, d)
    return c.select("row", "col", t.lon_of(F.col("col")).alias("lon"), t.lat_of(F.col("row")).alias("lat"))


@query(
    "jn_align_nearest",
    with_views([V.CELLS, TARGET], """SELECT t.row, t.col, c.elevation FROM (SELECT target.*, floor((lon - x0) / dx) AS sc, floor((y0 - lat) / dy) AS sr FROM target, grid) t
    LEFT JOIN cells c ON c.row = t.sr AND c.col = t.sc"""),
)
def jn_align_nearest(spark, d):
    return R.align_nearest(V.cells(spark, d), V.grid(spark, d), target_cells(spark, d), "elevation")


@query(
    "jn_align_bilinear",
    with_views(
        [V.CELLS, TARGET],
        """SELECT row, col, round(CASE WHEN sum(CASE WHEN v IS NOT NULL THEN wt END) > 0 THEN sum(wt * v) / sum(CASE WHEN v IS NOT NULL THEN wt END) END, 6) AS elevation FROM (
        SELECT t.row, t.col, (CASE WHEN dr = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) * (CASE WHEN dc = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) AS wt,
        c.elevation AS v FROM (SELECT target.row, target.col, (lon - x0) / dx - 0.5 AS u, (y0 - lat) / dy - 0.5 AS v FROM target, grid) t
        CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS o(dr, dc)
        LEFT JOIN cells c ON c.row = floor(t.v) + dr AND c.col = floor(t.u) + dc) GROUP BY 1, 2""",
    ),
)
def jn_align_bilinear(spark, d):
    return rounded(R.align_bilinear(V.cells(spark, d), V.grid(spark, d), target_cells(spark, d), "elevation"))


@query("jn_stack_layers", with_views([V.CELLS, V.BANDS_WIDE], f"SELECT row, col, b3, b1, b2 FROM bands_wide JOIN cells USING (row, col) WHERE b1 IS NOT NULL AND b2 IS NOT NULL AND b3 IS NOT NULL AND {PATCH_SQL}"))
def jn_stack_layers(spark, d):
    g = V.grid(spark, d)
    b = V.bands_long(spark, d).withColumns({"lon": g.lon_of(F.col("col")), "lat": g.lat_of(F.col("row"))})
    return R.stack(b, ["b3", "b1", "b2"], V.BAND_NAMES, PATCH)


PAIR_DELTA = """pairs AS (SELECT row, col, avg(suitability) AS future_mean FROM scenarios GROUP BY 1, 2)"""


@query("ag_scenario_ensemble", with_views([V.SCENARIOS], "SELECT row, col, round(avg(suitability), 6) AS future_mean, round(stddev_pop(suitability), 6) AS future_sd, count(suitability) AS n_scenarios FROM scenarios GROUP BY 1, 2"))
def ag_scenario_ensemble(spark, d):
    return rounded(SC.over_scenarios(V.scenarios(spark, d)))


@query("jn_delta", with_views([V.SCENARIOS, V.PRESENT, PAIR_DELTA], "SELECT row, col, round(future_mean - suitability, 6) AS delta FROM present FULL JOIN pairs USING (row, col)"))
def jn_delta(spark, d):
    return rounded(SC.change(SC.over_scenarios(V.scenarios(spark, d)), V.present(spark, d)).select("row", "col", "delta"))


LIMITS_SQL = """named(threshold_name, threshold) AS (VALUES ('maxTSS', 0.45::DOUBLE), ('p10', 0.3123456::DOUBLE), ('min_train', 0.05::DOUBLE)),
maps AS (SELECT 'presente' AS scenario, lat, suitability FROM present UNION ALL
  SELECT gcm || '_' || ssp, lat, suitability FROM scenarios)"""
AREA = """SELECT a.scenario, a.threshold_name, round(a.threshold, 4) AS threshold, round(a.area, 1) AS area_km2, round(a.area - p.area, 1) AS delta_km2
  FROM areas a JOIN areas p ON p.threshold_name = a.threshold_name AND p.scenario = 'presente'"""
CONST_AREA = f"areas AS (SELECT scenario, threshold_name, threshold, count(*) FILTER (suitability::FLOAT >= threshold::FLOAT) * {constant_pixel_km2()!r}::DOUBLE AS area FROM maps, named GROUP BY 1, 2, 3)"
TRUE_AREA = """areas AS (SELECT scenario, threshold_name, threshold, coalesce(sum(6378.137::DOUBLE * 6378.137::DOUBLE * radians(dx) * radians(dy) * cos(radians(lat)))
  FILTER (suitability::FLOAT >= threshold::FLOAT), 0) AS area FROM maps, named, grid GROUP BY 1, 2, 3)"""


def all_maps(spark, d):
    present = V.present(spark, d).select(F.lit("m").alias("map_id"), F.lit("presente").alias("scenario"), "lat", "suitability")
    future = V.scenarios(spark, d).select(
        F.lit("m").alias("map_id"), F.concat_ws("_", "gcm", "ssp").alias("scenario"), "lat", "suitability"
    )
    return present.unionByName(future)


def limits(spark):
    one = spark.createDataFrame([("m", 0.45, 0.3123456, 0.05)], "map_id string, maxTSS double, p10 double, min_train double")
    return SC.named_limits(one, ["map_id"])


@query("ag_area_table", with_views([V.SCENARIOS, V.PRESENT, LIMITS_SQL, CONST_AREA], AREA))
def ag_area_table(spark, d):
    return SC.area_table(all_maps(spark, d), limits(spark), ["map_id"]).drop("map_id")


@query("ag_area_table_true", with_views([V.SCENARIOS, V.PRESENT, LIMITS_SQL, TRUE_AREA], AREA))
def ag_area_table_true(spark, d):
    return SC.area_table(all_maps(spark, d), limits(spark), ["map_id"], V.grid(spark, d)).drop("map_id")


@query(
    "u_area_rows",
    with_views(
        [V.SCENARIOS, V.PRESENT, PAIR_DELTA, LIMITS_SQL.replace("maps AS (", "maps AS (SELECT 'futuro_mean' AS scenario, 0 AS lat, future_mean AS suitability FROM pairs UNION ALL "), CONST_AREA],
        AREA,
    ),
)
def u_area_rows(spark, d):
    maps = all_maps(spark, d)
    mean = SC.over_scenarios(V.scenarios(spark, d)).select(
        F.lit("m").alias("map_id"), F.lit("futuro_mean").alias("scenario"), F.lit(0.0).alias("lat"), F.col("future_mean").alias("suitability")
    )
    first = SC.area_table(maps, limits(spark), ["map_id"])
    second = SC.area_table(maps.filter("scenario = 'presente'").unionByName(mean), limits(spark), ["map_id"])
    return SC.merge_area_tables(first, second).drop("map_id")


BINARY = """SELECT row, col, threshold_name, CAST(suitability::FLOAT >= threshold::FLOAT AS INTEGER) AS suitable
  FROM (SELECT cells.row, cells.col, suitability FROM cells LEFT JOIN present USING (row, col)), named"""


@query("ag_binary_map", with_views([V.SCENARIOS, V.PRESENT, LIMITS_SQL], BINARY))
def ag_binary_map(spark, d):
    full = V.cells(spark, d).select("row", "col").join(V.present(spark, d).select("row", "col", "suitability"), ["row", "col"], "left")
    t = R.binary_map(full.withColumn("map_id", F.lit("m")), limits(spark), ["map_id"])
    return t.select("row", "col", "threshold_name", "suitable")


@query(
    "jn_thresholds",
    with_views([V.SCENARIOS, V.PRESENT, LIMITS_SQL], "SELECT scenario, threshold_name, count(*) FILTER (suitability::FLOAT >= threshold::FLOAT) AS n_suitable, count(*) AS n FROM maps, named GROUP BY 1, 2"),
)
def jn_thresholds(spark, d):
    t = R.binary_map(all_maps(spark, d), limits(spark), ["map_id"])
    return t.groupBy("scenario", "threshold_name").agg(F.count_if(F.col("suitable") == 1).alias("n_suitable"), F.count(F.lit(1)).alias("n"))


@query(
    "ag_raster_stats",
    with_views(
        [V.BANDS],
        """SELECT band, count(*) AS n, round(min(v), 6) AS min, round(max(v), 6) AS max, round(count(*) FILTER (v > 80) * 100::DOUBLE / count(*), 6) AS pct_steep,
        round(median(v), 6) AS median, round(quantile_cont(v, 0.02), 6) AS p02, round(quantile_cont(v, 0.98), 6) AS p98, round(quantile_cont(abs(v), 0.98), 6) AS abs_p98
        FROM (SELECT band, value / 1000000 - 5 AS v FROM bands_long) GROUP BY band""",
    ),
)
def ag_raster_stats(spark, d):
    b = V.bands_long(spark, d).select("band", (F.col("value") / 1000000 - 5).alias("v"))
    return rounded(R.statistics(b, ["band"], "v"))


@query(
    "ag_shared_range",
    with_views([V.SCENARIOS, V.PRESENT, PAIR_DELTA], "SELECT round(least(min(suitability), min(future_mean)), 6) AS low, round(greatest(max(suitability), max(future_mean)), 6) AS high FROM present FULL JOIN pairs USING (row, col)"),
)
def ag_shared_range(spark, d):
    both = SC.change(SC.over_scenarios(V.scenarios(spark, d)), V.present(spark, d))
    return rounded(both.agg(
        F.least(F.min("suitability"), F.min("future_mean")).alias("low"), F.greatest(F.max("suitability"), F.max("future_mean")).alias("high")
    ))


@query(
    "ag_alignment_check",
    with_views(
        [V.BANDS, "geo AS (SELECT band AS layer, max(row) - min(row) + 1 AS height, max(col) - min(col) + 1 AS width FROM bands_long GROUP BY band)"],
        """SELECT g.layer, concat_ws(',', CASE WHEN g.width <> f.width THEN 'width' END, CASE WHEN g.height <> f.height THEN 'height' END) AS mismatch,
        g.width = f.width AND g.height = f.height AS aligned FROM geo g, (SELECT * FROM geo WHERE layer = 'b1') f""",
    ),
)
def ag_alignment_check(spark, d):
    """Geometry of each band as covered by its cells, against the first band."""
    g = V.grid(spark, d)
    geo = V.bands_long(spark, d).groupBy(F.col("band").alias("layer")).agg(
        (F.max("row") - F.min("row") + 1).alias("height"), (F.max("col") - F.min("col") + 1).alias("width")
    )
    grids = geo.withColumns(
        {"position": F.col("layer"), "x0": F.lit(g.x0), "y0": F.lit(g.y0), "dx": F.lit(g.dx), "dy": F.lit(g.dy), "crs": F.lit("EPSG:4326")}
    )
    return R.alignment(grids)


@query(
    "ag_cell_coverage",
    with_views([V.BANDS], """SELECT count(*) FILTER (a.row IS NOT NULL AND b.row IS NOT NULL) AS n_both, count(*) FILTER (b.row IS NULL) AS n_first_only,
    count(*) FILTER (a.row IS NULL) AS n_second_only FROM (SELECT * FROM bands_long WHERE band = 'b1') a FULL JOIN (SELECT * FROM bands_long WHERE band = 'b2') b
    ON a.row = b.row AND a.col = b.col"""),
)
def ag_cell_coverage(spark, d):
    b = V.bands_long(spark, d)
    return R.cell_coverage(b.filter("band = 'b1'"), b.filter("band = 'b2'"))


@query(
    "u_mosaic",
    with_views([V.BANDS], "SELECT row, col, round(avg(value), 6) AS value FROM bands_long WHERE band IN ('b1', 'b2', 'b3') GROUP BY 1, 2"),
)
def u_mosaic(spark, d):
    b = V.bands_long(spark, d)
    parts = [b.filter(F.col("band") == n) for n in ("b1", "b2", "b3")]
    return rounded(R.mosaic([*parts, None], "value"))


ISO_SQL = "iso(name, iso3) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in S.ISO3.items()) + ")"
REAL = list(S.ISO3) + ["Uruguay", "Suriname"]
REAL_SQL = "CASE event_id % 10 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(REAL)) + " END"


@query("u_iso3", with_views([ISO_SQL], f"SELECT name AS country, iso3, count(*) AS n FROM (SELECT {REAL_SQL} AS name FROM events) JOIN iso USING (name) GROUP BY 1, 2"))
def u_iso3(spark, d):
    names = F.array(*[F.lit(n) for n in REAL])
    e = V.table(spark, d, "events").select(F.element_at(names, (F.col("event_id") % 10 + 1).cast("int")).alias("country"))
    return R.to_iso3(e).groupBy("country", "iso3").agg(F.count(F.lit(1)).alias("n"))


FAILED_VIEWS = [V.OCC, *TERRAIN_VIEWS, """records AS (SELECT o.rec_id, o.species, o.lon, o.lat,
  CASE WHEN rec_id % 7 < 3 THEN 0 ELSE 1000 + rec_id % 500 END::DOUBLE AS elevation, CASE WHEN rec_id % 7 < 3 THEN 0 ELSE rec_id % 90 END::DOUBLE AS slope,
  CASE WHEN rec_id % 7 < 3 THEN 0 ELSE 0.5 END::DOUBLE AS northness, CASE WHEN rec_id % 7 < 2 THEN 0 ELSE 0.25 END::DOUBLE AS eastness,
  t.elevation AS new_elevation, t.slope AS new_slope, rec_id % 7 < 2 AS failed FROM (SELECT occ.*, CAST(floor((lon - x0) / dx) AS BIGINT) AS col,
  CAST(floor((y0 - lat) / dy) AS BIGINT) AS row FROM occ, grid) o LEFT JOIN terrain t USING (row, col))"""]


def repaired(spark, d):
    g = V.grid(spark, d)
    i = F.col("rec_id")
    bad = i % 7 < 3
    rec = V.occ(spark, d).select(
        "rec_id", "species", "lon", "lat",
        F.when(bad, 0.0).otherwise((1000 + i % 500).cast("double")).alias("elevation"),
        F.when(bad, 0.0).otherwise((i % 90).cast("double")).alias("slope"),
        F.when(bad, 0.0).otherwise(0.5).alias("northness"),
        F.when(i % 7 < 2, 0.0).otherwise(0.25).alias("eastness"),
    )
    fresh = R.terrain(V.cells(spark, d), g)
    fresh = fresh.withColumnsRenamed({n: f"new_{n}" for n in S.TERRAIN})
    return RP.repair_topography(R.sample(rec, fresh, g, [f"new_{n}" for n in S.TERRAIN]))


@query(
    "jn_repair_topography",
    with_views(FAILED_VIEWS, """SELECT rec_id, species, lat, lon, elevation AS elevation_before, new_elevation AS elevation_after, slope AS slope_before,
    round(new_slope, 6) AS slope_after, round(new_elevation - elevation, 6) AS delta_elevation, failed AS corrected, failed AND new_elevation IS NULL AS still_missing FROM records"""),
)
def jn_repair_topography(spark, d):
    return RP.change_log(repaired(spark, d)).withColumns(
        {"slope_after": F.round("slope_after", 6), "delta_elevation": F.round("delta_elevation", 6)}
    )


@query(
    "ag_before_after",
    with_views(FAILED_VIEWS, """SELECT phase, count(v) AS n, round(avg(v), 6) AS mean, round(count(*) FILTER (v > 80) * 100::DOUBLE / count(v), 6) AS pct_over_80,
    min(v) AS min, round(quantile_cont(v, 0.25), 6) AS q1, round(median(v), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3, max(v) AS max FROM (
    SELECT 'before' AS phase, elevation AS v FROM records WHERE failed UNION ALL SELECT 'after', new_elevation FROM records WHERE failed) GROUP BY phase"""),
)
def ag_before_after(spark, d):
    return rounded(RP.before_after(repaired(spark, d), "elevation_before", "elevation", F.col("corrected")))


@query("ag_null_counts", with_views([V.ENV], "SELECT species, count(*) FILTER (elevation IS NULL) AS null_elevation, count(*) FILTER (b1 IS NULL) AS null_b1, count(*) FILTER (b2 IS NULL) AS null_b2 FROM env GROUP BY species"))
def ag_null_counts(spark, d):
    return A.null_counts(V.env(spark, d), ["elevation", "b1", "b2"], ["species"])


@query("ag_data_extent", with_views([V.OCC], "SELECT round(min(lon) - 1, 6) AS min_lon, round(min(lat) - 1, 6) AS min_lat, round(max(lon) + 1, 6) AS max_lon, round(max(lat) + 1, 6) AS max_lat FROM occ"))
def ag_data_extent(spark, d):
    return rounded(A.extent(V.occ(spark, d)))


@query("ag_fold_balance", with_views([V.SCORED], "SELECT species, cv_fold, sum(presence)::BIGINT AS n_presence, count(*) AS n FROM scored GROUP BY 1, 2"))
def ag_fold_balance(spark, d):
    return A.fold_balance(V.scored(spark, d))


AUDIT_ROWS = """audit AS (SELECT species, lon, lat, year, country, elevation, b1 AS bio5, b2 AS bio6, b1 - b2 + CASE WHEN rec_id % 50 = 1 THEN 1 ELSE 0 END AS bio7,
  b3 - 4000000 AS bio12, rec_id % 100 AS slope, 0::DOUBLE AS northness, 0::DOUBLE AS eastness FROM env
  UNION ALL SELECT species, lon, lat, year, country, NULL, NULL, NULL, NULL, NULL, 0, 0, 0 FROM env WHERE rec_id % 40 = 0)"""


@query(
    "ag_quality_audit",
    with_views(
        [V.ENV, AUDIT_ROWS],
        f"""SELECT count(*) AS n_rows, count(*) FILTER (NOT ({PATCH_SQL})) AS n_outside, count(*) FILTER (lon IS NULL OR lat IS NULL) AS n_null_coords,
        count(*) FILTER (elevation IS NULL OR bio5 IS NULL OR bio12 IS NULL) AS n_incomplete, count(*) FILTER (elevation < 0) AS n_elevation_negative,
        min(elevation) AS elevation_min, max(elevation) AS elevation_max, count(*) FILTER (slope NOT BETWEEN 0 AND 90) AS n_slope_out, 0::BIGINT AS n_exposure_out,
        count(*) FILTER (elevation = 0 AND slope = 0) AS n_flat_zero, count(*) FILTER (bio12 < 0) AS n_rain_negative,
        count(*) FILTER (abs(bio7 - (bio5 - bio6)) > 1e-6) AS n_range_mismatch, count(*) FILTER (bio5 < bio6) AS n_max_below_min,
        min(year) AS year_min, max(year) AS year_max, count(*) FILTER (year IS NULL) AS n_no_year, 13 AS n_columns,
        (SELECT sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM audit GROUP BY species, lat, lon)) AS n_duplicates,
        count(DISTINCT species) AS n_species, (SELECT count(*) FROM (SELECT species FROM audit GROUP BY species HAVING count(*) >= 50)) AS n_viable FROM audit""",
    ),
)
def ag_quality_audit(spark, d):
    e = V.env(spark, d)
    i = F.col("rec_id")
    base = e.select(
        "species", "lon", "lat", "year", "country", "elevation", F.col("b1").alias("bio5"), F.col("b2").alias("bio6"),
        (F.col("b1") - F.col("b2") + F.when(i % 50 == 1, 1.0).otherwise(0.0)).alias("bio7"), (F.col("b3") - 4000000).alias("bio12"),
        (i % 100).alias("slope"), F.lit(0.0).alias("northness"), F.lit(0.0).alias("eastness"),
    )
    copies = e.filter(i % 40 == 0).select("species", "lon", "lat", "year", "country", F.lit(0).cast("long").alias("slope"), F.lit(0.0).alias("northness"), F.lit(0.0).alias("eastness"))
    return A.quality(base.unionByName(copies, allowMissingColumns=True), ["elevation", "bio5", "bio12"], PATCH)


@query("ag_country_counts", with_views([V.OCC], "SELECT country, count(*) AS n FROM occ GROUP BY country"))
def ag_country_counts(spark, d):
    return V.occ(spark, d).groupBy("country").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "country")


@query(
    "jn_raster_at_points_scaled",
    with_views(
        [V.OCC, V.CELLS],
        """SELECT o.rec_id, row, col, c.elevation FROM (SELECT rec_id, CAST(trunc((lon - x0) / ((x0 + dx * w) - x0) * (w - 1)) AS BIGINT) AS col,
        CAST(trunc((y0 - lat) / (y0 - (y0 - dy * h)) * (h - 1)) AS BIGINT) AS row FROM occ, grid) o JOIN cells c USING (row, col)""",
    ),
)
def jn_raster_at_points_scaled(spark, d):
    pts = V.occ(spark, d).select("rec_id", "lon", "lat")
    return R.sample_scaled(pts, V.cells(spark, d), V.grid(spark, d), "elevation").select("rec_id", "row", "col", "elevation")


@query(
    "m_thresholds_heuristic",
    with_views(
        [V.OCC, V.PRESENT],
        """SELECT round(p10, 6) AS p10, round(least(greatest(2 * p10, 0), (SELECT max(suitability) FROM present)), 6) AS "maxTSS" FROM (
        SELECT quantile_cont(suitability, 0.1) AS p10 FROM (SELECT CAST(trunc((lon - x0) / ((x0 + dx * w) - x0) * (w - 1)) AS BIGINT) AS col,
        CAST(trunc((y0 - lat) / (y0 - (y0 - dy * h)) * (h - 1)) AS BIGINT) AS row FROM occ, grid) JOIN present USING (row, col))""",
    ),
)
def m_thresholds_heuristic(spark, d):
    from habitspark.operators.metrics import map_thresholds

    present = V.present(spark, d).withColumn("map_id", F.lit("m"))
    at = R.sample_scaled(V.occ(spark, d).select("lon", "lat"), present, V.grid(spark, d), "suitability").withColumn("map_id", F.lit("m"))
    return rounded(map_thresholds(present, at, ["map_id"]).drop("map_id"))
