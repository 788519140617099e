"""Joins by location."""

from __future__ import annotations

from pyspark.sql import functions as F

from habitspark.operators import cleaning as C
from habitspark.operators import spatial as SP
from habitspark.sources import polygons as P
from habitspark.suite import views as V
from habitspark.suite.cleaning import COSMO, FIXTURE_MIN_SQL, fixture_min
from habitspark.suite.metrics import rounded
from habitspark.suite.registry import query
from habitspark.suite.views import with_views

CROSS = "(e.y1 > {y}) <> (e.y2 > {y}) AND {x} < (e.x2 - e.x1) * ({y} - e.y1) / (e.y2 - e.y1) + e.x1"
HAV = """2 * 6371.0088::DOUBLE * asin(least(1, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2)
  + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"""
OCC_HITS = f"""hits AS (SELECT rec_id, feature_id FROM occ JOIN edges e ON {CROSS.format(x="occ.lon", y="occ.lat")}
  GROUP BY 1, 2 HAVING count(*) % 2 = 1)"""
CELL_HITS = f"""cell_hits AS (SELECT row, col, feature_id, max(admin) AS admin FROM cells JOIN edges e ON {CROSS.format(x="cells.lon", y="cells.lat")}
  GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)"""
CENTROIDS = """centroids AS (SELECT feature_id, name, sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) AS lon,
  sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) AS lat FROM edges GROUP BY 1, 2)"""


def edges(spark, d):
    return P.edges(V.polygons(spark, d), "name", "admin")


@query("jn_point_in_polygon", with_views([V.OCC, V.POLYGONS, OCC_HITS], "SELECT rec_id, species, lon, lat FROM occ WHERE rec_id IN (SELECT rec_id FROM hits)"))
def jn_point_in_polygon(spark, d):
    pts = V.occ(spark, d).select("rec_id", "species", "lon", "lat")
    return SP.keep_on_land(pts, edges(spark, d), ["rec_id"])


@query("jn_polygon_of_cell", with_views([V.CELLS, V.POLYGONS, CELL_HITS], "SELECT row, col, feature_id FROM cell_hits"))
def jn_polygon_of_cell(spark, d):
    return SP.covering(V.cells(spark, d), edges(spark, d), ["row", "col"])


@query("ag_polygon_centroid", with_views([V.POLYGONS, CENTROIDS], "SELECT feature_id, name, round(lon, 6) AS lon, round(lat, 6) AS lat FROM centroids"))
def ag_polygon_centroid(spark, d):
    return rounded(SP.polygon_centroids(edges(spark, d), "name"))


# another way to the distance: arc between reduced latitudes, with the flattening's first-order term (within a metre here)
CLOSE = """close AS (
  WITH pairs AS (SELECT o.rec_id, atan((1 - f) * tan(radians(o.lat))) AS u, atan((1 - f) * tan(radians(c.lat))) AS v, radians(c.lon - o.lon) AS w, f
    FROM occ o, centroids c, (SELECT 1 / 298.257223563::DOUBLE AS f)),
  arcs AS (SELECT *, 2 * asin(sqrt(least(1, pow(sin((v - u) / 2), 2) + cos(u) * cos(v) * pow(sin(w / 2), 2)))) AS s, (u + v) / 2 AS p, (v - u) / 2 AS q FROM pairs)
  SELECT rec_id FROM arcs WHERE s < 0.1 AND 6378137::DOUBLE * (s - f / 2 * CASE WHEN s = 0 THEN 0 ELSE
    (s - sin(s)) * pow(sin(p) * cos(q) / cos(s / 2), 2) + (s + sin(s)) * pow(cos(p) * sin(q) / sin(s / 2), 2) END) <= 60000)"""


@query("jn_centroid_anti", with_views([V.OCC, V.POLYGONS, CENTROIDS, CLOSE], "SELECT rec_id, species FROM occ WHERE rec_id NOT IN (SELECT rec_id FROM close)"))
def jn_centroid_anti(spark, d):
    c = SP.polygon_centroids(edges(spark, d))
    return SP.away_from_centroids(V.occ(spark, d), c, 60.0).select("rec_id", "species")


@query(
    "jn_country_mask",
    with_views([V.CELLS, V.POLYGONS, CELL_HITS], "SELECT c.row, c.col FROM cells c JOIN cell_hits h ON h.row = c.row AND h.col = c.col AND h.admin = 'REGION_2' WHERE land GROUP BY 1, 2"),
)
def jn_country_mask(spark, d):
    land = V.cells(spark, d).filter("land")
    return SP.calibration_cells(land, edges(spark, d), "REGION_2", ["ADMIN", "name", "admin"]).select("row", "col")


@query("jn_country_mask_bbox", with_views([V.CELLS], "SELECT row, col FROM cells WHERE land AND lon BETWEEN -76 AND -66 AND lat BETWEEN -56 AND -17"))
def jn_country_mask_bbox(spark, d):
    """Unknown country: the calibration box stands in."""
    land = V.cells(spark, d).filter("land")
    return SP.calibration_cells(land, edges(spark, d), "Nowhere", ["ADMIN", "name"]).select("row", "col")


TOUCHED = """segments AS (SELECT *, least(y1, y2) AS lo, greatest(y1, y2) AS hi FROM edges),
touched AS (SELECT DISTINCT row, col FROM (
  SELECT c.row, c.col, floor((least(xa, xb) - x0) / dx) AS c0, floor((greatest(xa, xb) - x0) / dx) AS c1 FROM (
    SELECT r.row, s.x1, s.y1, s.x2, s.y2, x0, dx,
      CASE WHEN y1 = y2 THEN x1 ELSE x1 + (greatest(lo, y0 - (r.row + 1) * dy) - y1) * ((x2 - x1) / (y2 - y1)) END AS xa,
      CASE WHEN y1 = y2 THEN x2 ELSE x1 + (least(hi, y0 - r.row * dy) - y1) * ((x2 - x1) / (y2 - y1)) END AS xb
    FROM segments s, grid, (SELECT DISTINCT row FROM cells) r
    WHERE r.row BETWEEN floor((y0 - hi) / dy) AND floor((y0 - lo) / dy)) t JOIN cells c ON c.row = t.row)
  WHERE col BETWEEN c0 AND c1)"""


@query(
    "jn_land_mask",
    with_views(
        [V.CELLS, V.POLYGONS, CELL_HITS, TOUCHED],
        """SELECT c.row, c.col, CASE WHEN m.row IS NULL THEN 0 ELSE 1 END AS mask FROM cells c LEFT JOIN (
        SELECT row, col FROM cell_hits UNION SELECT row, col FROM touched) m ON m.row = c.row AND m.col = c.col""",
    ),
)
def jn_land_mask(spark, d):
    return SP.land_mask(V.cells(spark, d), edges(spark, d), V.grid(spark, d))


@query(
    "jn_clip_presence",
    with_views(
        [V.OCC, V.CELLS],
        """SELECT rec_id, species FROM (SELECT occ.*, CAST(least(greatest(floor((lon - x0) / dx), 0), w - 1) AS BIGINT) AS col,
        CAST(least(greatest(floor((y0 - lat) / dy), 0), h - 1) AS BIGINT) AS row FROM occ, grid) JOIN cells c USING (row, col) WHERE c.land""",
    ),
)
def jn_clip_presence(spark, d):
    pts = V.occ(spark, d).select("rec_id", "species", "lon", "lat")
    return SP.presences_in(pts, V.cells(spark, d).filter("land"), V.grid(spark, d)).select("rec_id", "species")


DISTANCES = f"""distances AS (SELECT o.species, c.row, c.col, min({HAV.format(a="o", b="c")}) AS distance_km FROM occ o JOIN cells c
  ON c.land AND abs(c.lat - o.lat) <= 2.75 GROUP BY 1, 2, 3)"""


@query("jn_accessible_area", with_views([V.OCC, V.CELLS, DISTANCES], "SELECT species, row, col FROM distances WHERE distance_km <= 300"))
def jn_accessible_area(spark, d):
    return SP.accessible_cells(V.occ(spark, d), V.cells(spark, d).filter("land"))


@query("jn_nearest_presence", with_views([V.OCC, V.CELLS, DISTANCES], "SELECT species, row, col, round(distance_km, 6) AS distance_km FROM distances WHERE distance_km <= 300"))
def jn_nearest_presence(spark, d):
    return rounded(SP.nearest_presence(V.occ(spark, d), V.cells(spark, d).filter("land")))


HULL_GAPS = """pts AS (SELECT DISTINCT species, lon, lat FROM occ),
gaps AS (SELECT species, lon, lat, max(g) AS gap FROM (
  SELECT species, lon, lat, coalesce(lead(ang) OVER (PARTITION BY species, lon, lat ORDER BY ang),
    min(ang) OVER (PARTITION BY species, lon, lat) + 2 * pi()) - ang AS g FROM (
    SELECT a.species, a.lon, a.lat, atan2(b.lat - a.lat, b.lon - a.lon) AS ang FROM pts a JOIN pts b
    ON a.species = b.species AND (a.lon <> b.lon OR a.lat <> b.lat))) GROUP BY 1, 2, 3)"""


@query("ag_convex_hull", with_views([V.OCC, HULL_GAPS], "SELECT species, lon, lat FROM gaps WHERE gap > pi() + 1e-9"))
def ag_convex_hull(spark, d):
    return SP.convex_hull(V.occ(spark, d)).select("species", "lon", "lat")


IN_HULL = """near_cells AS (SELECT p.species, c.row, c.col, c.lon, c.lat FROM cells c JOIN (SELECT species, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n
  FROM occ GROUP BY species) p ON c.elevation IS NOT NULL AND c.lon BETWEEN w AND e AND c.lat BETWEEN s AND n),
in_hull AS (SELECT species, row, col FROM (
  SELECT species, row, col, coalesce(lead(ang) OVER (PARTITION BY species, row, col ORDER BY ang),
    min(ang) OVER (PARTITION BY species, row, col) + 2 * pi()) - ang AS g FROM (
    SELECT a.species, a.row, a.col, atan2(b.lat - a.lat, b.lon - a.lon) AS ang FROM near_cells a
    JOIN (SELECT DISTINCT species, lon, lat FROM occ) b ON a.species = b.species)) GROUP BY 1, 2, 3 HAVING max(g) <= pi())"""


@query("jn_hull_contains", with_views([V.OCC, V.CELLS, IN_HULL], "SELECT species, row, col FROM in_hull"))
def jn_hull_contains(spark, d):
    cells = V.cells(spark, d).filter("elevation IS NOT NULL")
    return SP.cells_in_hull(SP.convex_hull(V.occ(spark, d)), cells, V.grid(spark, d))


SMALL = f"small AS (SELECT * FROM occ WHERE species IN (SELECT species FROM occ GROUP BY species HAVING count(*) < {FIXTURE_MIN_SQL}))"


@query(
    "ml_eoo",
    with_views(
        [V.OCC, V.CELLS, SMALL, IN_HULL.replace("FROM occ", "FROM small"),
         f"""far AS (SELECT o.species, c.row, c.col, min({HAV.format(a="o", b="c")}) AS distance_km FROM small o JOIN cells c
         ON c.elevation IS NOT NULL AND abs(c.lat - o.lat) <= 4.7 GROUP BY 1, 2, 3)"""],
        """SELECT f.species, f.row, f.col, round(CASE WHEN h.row IS NOT NULL THEN 1 ELSE exp(-((distance_km / 50) * (distance_km / 50))) END, 6) AS suitability
        FROM far f LEFT JOIN in_hull h ON h.species = f.species AND h.row = f.row AND h.col = f.col WHERE distance_km <= 510""",
    ),
)
def ml_eoo(spark, d):
    """Range maps of the species too small for a model."""
    o = V.occ(spark, d)
    small = C.label_groups(o, COSMO, fixture_min(spark, d)).filter("`group` = 'C'")
    return rounded(SP.range_map(small, V.cells(spark, d).filter("elevation IS NOT NULL"), V.grid(spark, d)))


@query("u_mask_intersect", with_views([V.CELLS, V.POLYGONS, CELL_HITS], "SELECT row, col FROM cells WHERE land INTERSECT SELECT row, col FROM cell_hits"))
def u_mask_intersect(spark, d):
    land = V.cells(spark, d).filter("land").select("row", "col")
    country = SP.covering(V.cells(spark, d), edges(spark, d), ["row", "col"]).select("row", "col")
    return land.intersect(country)


@query("u_mask_subtract", with_views([V.CELLS, V.POLYGONS, CELL_HITS], "SELECT row, col FROM cells WHERE land EXCEPT SELECT row, col FROM cell_hits"))
def u_mask_subtract(spark, d):
    land = V.cells(spark, d).filter("land").select("row", "col")
    country = SP.covering(V.cells(spark, d), edges(spark, d), ["row", "col"]).select("row", "col").distinct()
    return land.join(country, ["row", "col"], "left_anti")
