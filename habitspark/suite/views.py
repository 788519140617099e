"""Input views with the engine's table shapes, derived from the given tables.

Each view exists twice: as a DataFrame here and as SQL text for the check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitspark import settings as S
from habitspark.functions.geo import Grid
from habitspark.operators import raster
from habitspark.plans.scale import dealt


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def species_name(index) -> F.Column:
    return F.concat(F.lit("Sp "), F.lpad(index.cast("string"), 2, "0"))


def occ(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrence records from ``events``."""
    e = table(spark, folder, "events")
    sp = F.pmod(F.col("user_id"), F.lit(16))
    i, u = F.col("event_id"), F.col("user_id")
    return e.select(
        i.alias("rec_id"),
        i.alias("ingest_ord"),
        species_name(sp).alias("species"),
        (F.lit(-7600000) + sp * 220000 + (i * 7919 + u * 104729) % 600000).alias("lon_e5"),
        (F.lit(-5000000) + sp * 350000 + (i * 6101 + u * 15485863) % 800000).alias("lat_e5"),
        F.when(i % 3 != 0, F.col("value") * 200.0).alias("uncertainty_m"),
        F.concat(F.lit("NATION_"), (i % 25).cast("string")).alias("country"),
        (F.lit(1980) + i % 45).cast("int").alias("year"),
        F.col("ts"),
    ).withColumns({"lon": F.col("lon_e5") / F.lit(100000.0), "lat": F.col("lat_e5") / F.lit(100000.0)})


OCC = """occ AS (
  SELECT *, lon_e5 / CAST(100000 AS DOUBLE) AS lon, lat_e5 / CAST(100000 AS DOUBLE) AS lat FROM (
    SELECT event_id AS rec_id, event_id AS ingest_ord,
           'Sp ' || lpad(CAST(user_id % 16 AS VARCHAR), 2, '0') AS species,
           -7600000 + (user_id % 16) * 220000 + (event_id * 7919 + user_id * 104729) % 600000 AS lon_e5,
           -5000000 + (user_id % 16) * 350000 + (event_id * 6101 + user_id * 15485863) % 800000 AS lat_e5,
           CASE WHEN event_id % 3 <> 0 THEN value * 200.0 END AS uncertainty_m,
           'NATION_' || CAST(event_id % 25 AS VARCHAR) AS country,
           CAST(1980 + event_id % 45 AS INTEGER) AS year, ts
    FROM events))"""


def occ_dirty(spark: SparkSession, folder: str) -> DataFrame:
    """``occ`` with the usual defects: null, zero, out-of-range, truncated, repeated."""
    base = occ(spark, folder)
    i = F.col("rec_id")
    lon = F.when(i % 97 == 0, 0.0).when(i % 79 == 0, F.floor("lon").cast("double")).otherwise(F.col("lon"))
    lat = (
        F.when(i % 97 == 0, 0.0)
        .when(i % 89 == 0, 95.0)
        .when(i % 83 == 0, None)
        .when(i % 79 == 0, F.floor("lat").cast("double"))
        .otherwise(F.col("lat"))
    )
    bad = base.withColumns({"lon": lon, "lat": lat}).drop("lon_e5", "lat_e5")
    copies = bad.filter(i % 50 == 0).withColumns(
        {"rec_id": i + 1_000_000_000, "ingest_ord": F.col("ingest_ord") + 1_000_000_000}
    )
    return bad.unionByName(copies)


OCC_DIRTY = """occ_bad AS (
  SELECT rec_id, ingest_ord, species, uncertainty_m, country, year, ts,
         CASE WHEN rec_id % 97 = 0 THEN 0.0 WHEN rec_id % 79 = 0 THEN floor(lon) ELSE lon END AS lon,
         CASE WHEN rec_id % 97 = 0 THEN 0.0 WHEN rec_id % 89 = 0 THEN 95.0 WHEN rec_id % 83 = 0 THEN NULL
              WHEN rec_id % 79 = 0 THEN floor(lat) ELSE lat END AS lat
  FROM occ),
occ_dirty AS (
  SELECT * FROM occ_bad UNION ALL
  SELECT rec_id + 1000000000, ingest_ord + 1000000000, species, uncertainty_m, country, year, ts, lon, lat
  FROM occ_bad WHERE rec_id % 50 = 0)"""


_ORDERS: dict[str, int] = {}


def grid(spark: SparkSession, folder: str) -> Grid:
    if folder not in _ORDERS:
        _ORDERS[folder] = table(spark, folder, "orders").count()
    n = _ORDERS[folder]
    width = 30 if n < 5000 else 100 if n < 50000 else 300
    height = n // width
    return Grid(-82.0, 13.0, 48.0 / width, 69.0 / height, width, height)


GRID = """grid AS (
  SELECT w, n // w AS h, CAST(48 AS DOUBLE) / w AS dx, CAST(69 AS DOUBLE) / (n // w) AS dy,
         CAST(-82 AS DOUBLE) AS x0, CAST(13 AS DOUBLE) AS y0
  FROM (SELECT count(*) AS n, CASE WHEN count(*) < 5000 THEN 30 WHEN count(*) < 50000 THEN 100 ELSE 300 END AS w
        FROM orders))"""


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """Raster cells from ``orders``: elevation with gaps and a land flag."""
    g = grid(spark, folder)
    k = F.col("o_orderkey")
    pos = table(spark, folder, "orders").select(
        F.floor(k / F.lit(g.width)).cast("long").alias("row"),
        (k % g.width).alias("col"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 100.0).alias("elevation"),
        (F.col("o_orderstatus") != "P").alias("land"),
    )
    return pos.select(
        "row", "col", g.lon_of(F.col("col")).alias("lon"), g.lat_of(F.col("row")).alias("lat"), "elevation", "land"
    )


CELLS = """cells AS (
  SELECT o_orderkey // w AS row, o_orderkey % w AS col,
         x0 + (o_orderkey % w + CAST(0.5 AS DOUBLE)) * dx AS lon,
         y0 - (o_orderkey // w + CAST(0.5 AS DOUBLE)) * dy AS lat,
         CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / CAST(100 AS DOUBLE) END AS elevation,
         o_orderstatus <> 'P' AS land
  FROM orders, grid)"""


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of ``lineitem`` as pixel, band number and cents."""
    g = grid(spark, folder)
    k = F.col("l_orderkey")
    lines = table(spark, folder, "lineitem").select(
        F.floor(k / F.lit(g.width)).cast("long").alias("row"),
        (k % g.width).alias("col"),
        F.col("l_linenumber").alias("number"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
    )
    return dealt(lines, ["row", "col"], g.width * g.height)


def bands_long(spark: SparkSession, folder: str) -> DataFrame:
    """Band values per cell from ``lineitem``; cells without a row stay missing."""
    band = F.concat(F.lit("b"), F.col("number").cast("string")).alias("band")
    mean = (F.sum("cents").cast("double") / F.count("cents").cast("double")).alias("value")
    return _lines(spark, folder).groupBy("row", "col", "number").agg(mean).select("row", "col", band, "value")


BANDS = """bands_long AS (
  SELECT l_orderkey // w AS row, l_orderkey % w AS col, 'b' || CAST(l_linenumber AS VARCHAR) AS band,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) AS value
  FROM lineitem, grid GROUP BY 1, 2, 3)"""

BAND_NAMES = [f"b{i}" for i in range(1, 8)]


def bands_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Bands of a cell side by side; one sum over the lines, unused bands fall away."""

    def mean(i: int) -> F.Column:
        cents = F.when(F.col("number") == i, F.col("cents"))
        n = F.count(cents)
        return F.when(n > 0, F.sum(cents).cast("double") / F.when(n > 0, n.cast("double")))

    return _lines(spark, folder).groupBy("row", "col").agg(*[mean(i + 1).alias(b) for i, b in enumerate(BAND_NAMES)])


BANDS_WIDE = (
    "bands_wide AS (SELECT row, col, "
    + ", ".join(f"max(CASE WHEN band = '{b}' THEN value END) AS {b}" for b in BAND_NAMES)
    + " FROM bands_long GROUP BY row, col)"
)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Out-of-fold scores of five algorithms from ``lineitem``."""
    li = table(spark, folder, "lineitem")
    return li.select(
        species_name(F.pmod(F.col("l_suppkey"), F.lit(16))).alias("species"),
        (F.col("l_linenumber") % 5).cast("int").alias("cv_fold"),
        (F.col("l_returnflag") == "R").cast("int").alias("presence"),
        (F.col("l_quantity") / 50.0).alias("glm"),
        (F.col("l_extendedprice") / 105000.0).alias("gam"),
        (F.col("l_discount") * 10.0).alias("rf"),
        (F.col("l_tax") * 12.5).alias("gbm"),
        F.when(
            F.col("l_partkey") % 11 != 0, F.col("l_extendedprice") * F.col("l_discount") / 10500.0
        ).alias("maxent"),
    )


SCORED = """scored AS (
  SELECT 'Sp ' || lpad(CAST(l_suppkey % 16 AS VARCHAR), 2, '0') AS species, CAST(l_linenumber % 5 AS INTEGER) AS cv_fold,
         CAST(l_returnflag = 'R' AS INTEGER) AS presence,
         l_quantity / CAST(50 AS DOUBLE) AS glm, l_extendedprice / CAST(105000 AS DOUBLE) AS gam,
         l_discount * CAST(10 AS DOUBLE) AS rf, l_tax * CAST(12.5 AS DOUBLE) AS gbm,
         CASE WHEN l_partkey % 11 <> 0 THEN l_extendedprice * l_discount / CAST(10500 AS DOUBLE) END AS maxent
  FROM lineitem)"""


def scored_long(spark: SparkSession, folder: str) -> DataFrame:
    return (
        scored(spark, folder)
        .unpivot(["species", "cv_fold", "presence"], S.ALGORITHMS, "algo", "score")
        .filter(F.col("score").isNotNull())
    )


SCORED_LONG = (
    "scored_long AS (\n  "
    + "\n  UNION ALL ".join(
        f"SELECT species, cv_fold, presence, '{a}' AS algo, {a} AS score FROM scored WHERE {a} IS NOT NULL"
        for a in S.ALGORITHMS
    )
    + ")"
)

HEXAGON = [(4, 0), (2, 5), (-2, 5), (-4, 0), (-2, -5), (2, -5), (4, 0)]


def polygons(spark: SparkSession, folder: str) -> DataFrame:
    """Vertex table with one closed hexagon per nation."""
    ring = F.explode(
        F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(x).alias("ox"), F.lit(y).alias("oy"))
                  for i, (x, y) in enumerate(HEXAGON)])
    ).alias("v")
    k = F.col("n_nationkey")
    return (
        table(spark, folder, "nation")
        .select(k.cast("long").alias("feature_id"), F.col("n_name").alias("name"), F.col("n_regionkey"), ring)
        .select(
            "feature_id",
            "name",
            F.concat(F.lit("REGION_"), F.col("n_regionkey").cast("string")).alias("admin"),
            F.lit(0).alias("ring_id"),
            F.col("v.seq").alias("seq"),
            (F.lit(-80) + F.col("feature_id") % 5 * 9 + F.col("v.ox")).cast("double").alias("lon"),
            (F.lit(8) - F.floor(F.col("feature_id") / 5) * 13 + F.col("v.oy")).cast("double").alias("lat"),
        )
    )


POLYGONS = (
    """polygons AS (
  SELECT CAST(n_nationkey AS BIGINT) AS feature_id, n_name AS name, 'REGION_' || CAST(n_regionkey AS VARCHAR) AS admin,
         0 AS ring_id, seq,
         CAST(-80 + (n_nationkey % 5) * 9 + ox AS DOUBLE) AS lon, CAST(8 - (n_nationkey // 5) * 13 + oy AS DOUBLE) AS lat
  FROM nation, (VALUES """
    + ", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(HEXAGON))
    + """) AS v(seq, ox, oy)),
edges AS (
  SELECT a.feature_id, a.name, a.admin, a.lon AS x1, a.lat AS y1, b.lon AS x2, b.lat AS y2
  FROM polygons a JOIN polygons b ON a.feature_id = b.feature_id AND b.seq = a.seq + 1)"""
)


def scenarios(spark: SparkSession, folder: str) -> DataFrame:
    """Suitability per cell for every species-free climate scenario."""
    gcm = F.explode(F.array(*[F.struct(F.lit(i).alias("gi"), F.lit(g).alias("gcm")) for i, g in enumerate(S.GCMS)]))
    ssp = F.explode(F.array(*[F.struct(F.lit(i).alias("si"), F.lit(s).alias("ssp")) for i, s in enumerate(S.SSPS)]))
    c = cells(spark, folder).filter("elevation IS NOT NULL").select("row", "col", "lat")
    s = c.withColumn("g", gcm).withColumn("s", ssp)
    step = (F.col("row") * 31 + F.col("col") * 17 + F.col("g.gi") * 7 + F.col("s.si") * 13) % 101
    return s.select(
        "row", "col", "lat", F.col("g.gcm").alias("gcm"), F.col("s.ssp").alias("ssp"), (step / 100.0).alias("suitability")
    )


SCENARIOS = (
    "scenarios AS (SELECT row, col, lat, gcm, ssp, "
    "((row * 31 + col * 17 + gi * 7 + si * 13) % 101) / CAST(100 AS DOUBLE) AS suitability "
    "FROM cells, (VALUES "
    + ", ".join(f"({i}, '{g}')" for i, g in enumerate(S.GCMS))
    + ") AS g(gi, gcm), (VALUES "
    + ", ".join(f"({i}, '{s}')" for i, s in enumerate(S.SSPS))
    + ") AS s(si, ssp) WHERE elevation IS NOT NULL)"
)


def present(spark: SparkSession, folder: str) -> DataFrame:
    c = cells(spark, folder).filter("elevation IS NOT NULL")
    return c.select("row", "col", "lat", ((F.col("row") * 31 + F.col("col") * 17) % 97 / 96.0).alias("suitability"))


PRESENT = (
    "present AS (SELECT row, col, lat, ((row * 31 + col * 17) % 97) / CAST(96 AS DOUBLE) AS suitability "
    "FROM cells WHERE elevation IS NOT NULL)"
)


def env(spark: SparkSession, folder: str) -> DataFrame:
    """Records with elevation and bands of the pixel they fall in."""
    layers = cells(spark, folder).join(bands_wide(spark, folder), ["row", "col"], "left")
    points = occ(spark, folder).select("rec_id", "species", "country", "year", "lon", "lat")
    return raster.sample(points, layers, grid(spark, folder), ["elevation", *BAND_NAMES])


ENV = (
    "env AS (SELECT o.rec_id, o.species, o.country, o.year, o.lon, o.lat, c.elevation, "
    + ", ".join(f"b.{b}" for b in BAND_NAMES)
    + """ FROM (SELECT occ.*, CAST(floor((lon - x0) / dx) AS BIGINT) AS col, CAST(floor((y0 - lat) / dy) AS BIGINT) AS row
  FROM occ, grid) o LEFT JOIN cells c USING (row, col) LEFT JOIN bands_wide b USING (row, col))"""
)

FEATURES = [f"f{i}" for i in range(6)]


def features(spark: SparkSession, folder: str) -> DataFrame:
    """Presence/background rows from ``embeddings`` with six predictors and a position."""
    e = F.col("embedding")
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.lit("Species e").alias("species"),
        (F.col("label") < 3).cast("int").alias("presence"),
        *[e[i].cast("double").alias(f"f{i}") for i in range(6)],
        (e[6].cast("double") * 20.0 - 60.0).alias("lon"),
        (e[7].cast("double") * 20.0 - 30.0).alias("lat"),
    )


def feature_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Grid cells with the predictors of ``features``, spread over their usual range."""
    c = cells(spark, folder)
    z = (F.col("elevation") - 2500.0) / 10000.0
    waves = [F.sin((F.col("row") * (i + 1) + F.col("col") * (6 - i)) / 17.0) * 0.2 + z for i in range(6)]
    return c.select("row", "col", "lon", "lat", *[w.alias(f"f{i}") for i, w in enumerate(waves)])


_NEEDS = {"env AS": [OCC, GRID, CELLS, BANDS, BANDS_WIDE], "cells AS": [GRID], "bands_long AS": [GRID], "bands_wide AS": [GRID, BANDS], "scored_long AS": [SCORED],
          "scenarios AS": [GRID, CELLS], "present AS": [GRID, CELLS], "occ_bad AS": [OCC]}


def with_views(views: list[str], body: str) -> str:
    """SQL with the named views, and those they build on, in front."""
    ordered: list[str] = []
    for view in views:
        for start, needed in _NEEDS.items():
            if view.startswith(start):
                ordered += [n for n in needed if n not in ordered]
        if view not in ordered:
            ordered.append(view)
    return "WITH " + ",\n".join(ordered) + "\n" + body
