"""Background sampling, weights, predictor choice, folds and environmental similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from habitspark import settings as S
from habitspark.operators import audit as A
from habitspark.operators import folds as FD
from habitspark.operators import mess as ME
from habitspark.operators import sampling as SM
from habitspark.operators import selection as SE
from habitspark.operators import spatial as SP
from habitspark.operators import training as TR
from habitspark.sources.rasters import full_grid
from habitspark.suite import views as V
from habitspark.suite.metrics import rounded
from habitspark.suite.registry import query
from habitspark.suite.spatial import DISTANCES
from habitspark.suite.views import with_views

VARS = ["elevation", "b1", "b2"]
COMPLETE = "elevation IS NOT NULL AND b1 IS NOT NULL AND b2 IS NOT NULL"
DRAW_SQL = "((row * 7919 + col * 104729) % 1000003) / 1000003::DOUBLE"


def draw():
    """Uniform value of a cell that SQL can repeat."""
    return (F.col("row") * 7919 + F.col("col") * 104729) % 1000003 / F.lit(1000003.0)


@query(
    "w_sample_uniform",
    with_views([V.CELLS], f"SELECT row, col FROM (SELECT row, col, row_number() OVER (ORDER BY {DRAW_SQL}, row, col) AS rn FROM cells WHERE land) WHERE rn <= 400"),
)
def w_sample_uniform(spark, d):
    return SM.sample_cells(V.cells(spark, d).filter("land").select("row", "col"), [], 400, draw=draw())


@query(
    "w_sample_per_species",
    with_views(
        [V.OCC, V.CELLS, DISTANCES],
        f"""SELECT species, row, col FROM (SELECT species, row, col, row_number() OVER (PARTITION BY species ORDER BY {DRAW_SQL}, row, col) AS rn
        FROM distances WHERE distance_km <= 300) WHERE rn <= 200""",
    ),
)
def w_sample_per_species(spark, d):
    area = SP.accessible_cells(V.occ(spark, d), V.cells(spark, d).filter("land"))
    return SM.sample_cells(area, ["species"], 200, draw=draw())


@query(
    "w_jitter",
    with_views(
        [V.CELLS],
        """SELECT row, col, round(x0 + (col + 0.5::DOUBLE) * dx + ((row * 7919 + col * 104729) % 1000003 / 1000003.0::DOUBLE - 0.5::DOUBLE) * dx, 6) AS lon,
        round(y0 - (row + 0.5::DOUBLE) * dy + ((row * 6101 + col * 15485863) % 1000003 / 1000003.0::DOUBLE - 0.5::DOUBLE) * dy, 6) AS lat
        FROM cells, (SELECT x0, y0, dx, dy FROM grid) WHERE land""",
    ),
)
def w_jitter(spark, d):
    """Every land cell moved inside its pixel."""
    land = V.cells(spark, d).filter("land").select("row", "col")
    north = (F.col("row") * 6101 + F.col("col") * 15485863) % 1000003 / F.lit(1000003.0)
    moved = SM.jitter(land, V.grid(spark, d), draws=(draw(), north))
    return moved.select("row", "col", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


EFFORT = """placed AS (SELECT CAST(least(greatest(floor((lon - x0) / dx), 0), w - 1) AS BIGINT) AS col,
  CAST(least(greatest(floor((y0 - lat) / dy), 0), h - 1) AS BIGINT) AS row FROM occ, grid),
effort AS (SELECT c.row, c.col, coalesce(n, 0) + 1 AS effort FROM cells c LEFT JOIN (SELECT row, col, count(*) AS n FROM placed GROUP BY 1, 2) p
  ON c.row = p.row AND c.col = p.col WHERE land)"""


@query("ag_effort", with_views([V.OCC, V.CELLS, EFFORT], "SELECT row, col, effort, round(effort::DOUBLE / (SELECT sum(effort) FROM effort)::DOUBLE, 9) AS probability FROM effort"))
def ag_effort(spark, d):
    e = SM.effort(V.occ(spark, d), V.cells(spark, d).filter("land"), V.grid(spark, d))
    return e.withColumn("probability", F.round("probability", 9))


@query(
    "w_sample_weighted",
    with_views(
        [
            V.OCC, V.CELLS, EFFORT,
            "lines AS (SELECT row, col, effort, sum(effort) OVER (ORDER BY row, col) AS hi, sum(effort) OVER () AS total FROM effort)",
            "draws AS (SELECT id AS draw, floor((id * 7919 + 13) % 1000003 / 1000003.0::DOUBLE * (SELECT max(total) FROM lines)::DOUBLE) AS u FROM range(20000) t(id))",
        ],
        "SELECT draw, row, col FROM draws JOIN lines ON u >= hi - effort AND u < hi",
    ),
)
def w_sample_weighted(spark, d):
    """Draws with replacement over land, proportional to collecting effort."""
    e = SM.effort(V.occ(spark, d), V.cells(spark, d).filter("land"), V.grid(spark, d))
    return SM.sample_by_effort(e, 20_000, draw=(F.col("id") * 7919 + 13) % 1000003 / F.lit(1000003.0))


@query(
    "ag_prevalence_weights",
    with_views([V.SCORED], """SELECT species, presence, count(*) AS n, round(max(CASE WHEN presence = 1 THEN 1 ELSE p / b::DOUBLE END), 6) AS weight FROM (
    SELECT *, count(*) FILTER (presence = 1) OVER (PARTITION BY species) AS p, count(*) FILTER (presence = 0) OVER (PARTITION BY species) AS b FROM scored) GROUP BY 1, 2"""),
)
def ag_prevalence_weights(spark, d):
    t = SM.case_weights(V.scored(spark, d))
    return rounded(t.groupBy("species", "presence").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight")))


@query(
    "ag_algorithm_weights",
    with_views([V.SCORED], """SELECT species, round(sum(CASE WHEN presence = 1 THEN 1 ELSE p / b::DOUBLE END), 4) AS glm_total, round(sum(1::DOUBLE), 4) AS maxent_total FROM (
    SELECT *, count(*) FILTER (presence = 1) OVER (PARTITION BY species) AS p, count(*) FILTER (presence = 0) OVER (PARTITION BY species) AS b FROM scored) GROUP BY 1"""),
)
def ag_algorithm_weights(spark, d):
    t = SM.weights_per_algorithm(V.scored(spark, d))
    return t.groupBy("species").agg(F.round(F.sum("weight_glm"), 4).alias("glm_total"), F.round(F.sum("weight_maxent"), 4).alias("maxent_total"))


@query("u_presence_background", with_views([V.OCC, V.CELLS], "SELECT 1 AS presence, lon, lat, species FROM occ UNION ALL SELECT 0, lon, lat, NULL FROM cells WHERE land"))
def u_presence_background(spark, d):
    pres = V.occ(spark, d).select("lon", "lat", "species")
    return SM.presence_background(pres, V.cells(spark, d).filter("land").select("lon", "lat")).select("presence", "lon", "lat", "species")


ENV_OK = f"env_ok AS (SELECT * FROM env WHERE {COMPLETE})"


@query(
    "ag_scaler",
    with_views([V.ENV, ENV_OK], "\nUNION ALL ".join(f"SELECT species, '{v}' AS feature, round(avg({v}), 4) AS mean, round(CASE WHEN stddev_pop({v}) = 0 THEN 1 ELSE stddev_pop({v}) END, 4) AS sd FROM env_ok GROUP BY species" for v in VARS)),
)
def ag_scaler(spark, d):
    t = SE.scaler(V.env(spark, d).na.drop(subset=VARS), VARS, ["species"])
    return t.withColumns({"mean": F.round("mean", 4), "sd": F.round("sd", 4)})


CORR = "cor AS (SELECT species, count(*) AS n, corr(elevation, b1) AS r01, corr(elevation, b2) AS r02, corr(b1, b2) AS r12 FROM env_ok GROUP BY species HAVING count(*) > 3)"


def crowded(df):
    """Species with rows enough for an inflation of three variables."""
    n = df.groupBy("species").agg(F.count(F.lit(1)).alias("n")).filter("n > 3").select("species")
    return df.join(n, "species", "left_semi")


@query(
    "ag_corr_matrix",
    with_views(
        [V.ENV, ENV_OK],
        " UNION ALL ".join(
            f"SELECT species, '{a}' AS var_a, '{b}' AS var_b, round(CASE WHEN var_samp({a}) > 0 AND var_samp({b}) > 0 THEN corr({a}, {b}) END, 6) AS r FROM env_ok GROUP BY species"
            for a, b in (("elevation", "b1"), ("elevation", "b2"), ("b1", "b2"))
        ),
    ),
)
def ag_corr_matrix(spark, d):
    return rounded(SE.correlations(V.env(spark, d), VARS, ["species"]))


@query(
    "ag_corr_pairs",
    with_views([V.SCORED], "SELECT species, 'rf' AS var_a, 'maxent' AS var_b, round(corr(rf, maxent), 6) AS r FROM scored WHERE maxent IS NOT NULL GROUP BY species HAVING abs(corr(rf, maxent)) >= 0.6"),
)
def ag_corr_pairs(spark, d):
    """Pairs of retained variables that are still strongly correlated."""
    return rounded(SE.correlated_pairs(V.scored(spark, d), ["rf", "maxent"], ["species"], 0.6))


@query(
    "ag_vif",
    with_views(
        [V.ENV, ENV_OK, CORR],
        "\nUNION ALL ".join(
            f"SELECT species, '{v}' AS feature, CASE WHEN r2 >= 1 - 1e-12::DOUBLE THEN 'inf'::DOUBLE ELSE round(1 / (1 - r2), 4) END AS vif FROM "
            f"(SELECT species, ({a} * {a} + {b} * {b} - 2 * {a} * {b} * {c}) / (1 - {c} * {c}) AS r2 FROM cor)"
            for v, a, b, c in (("elevation", "r01", "r02", "r12"), ("b1", "r01", "r12", "r02"), ("b2", "r02", "r12", "r01"))
        ),
    ),
)
def ag_vif(spark, d):
    t = SE.vif(crowded(V.env(spark, d).na.drop(subset=VARS)), VARS, ["species"])
    return t.withColumn("vif", F.round("vif", 4))


@query("ag_select_predictors")
def ag_select_predictors(spark, d):
    """Chosen variables per species from seven partly redundant candidates."""
    s = V.scored(spark, d).withColumns({"both": F.col("glm") + F.col("gam"), "twice": F.col("gam") * 2.0})
    return SE.select_predictors(s.filter("presence = 1"), [*S.ALGORITHMS, "both", "twice"], ["species"])


@query(
    "ag_select_by_correlation",
    with_views([V.SCORED], """SELECT species, CASE WHEN abs(corr(rf, maxent)) > 0.7 THEN CASE WHEN var_samp(rf) >= var_samp(maxent) THEN 'rf' ELSE 'maxent' END
    ELSE 'rf,maxent' END AS kept FROM scored WHERE maxent IS NOT NULL GROUP BY species"""),
)
def ag_select_by_correlation(spark, d):
    t = SE.select_predictors(V.scored(spark, d), ["rf", "maxent"], ["species"], vif_limit=float("inf"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "predictor"))), lambda p: p["predictor"])
    return t.groupBy("species").agg(F.array_join(ordered, ",").alias("kept"))


CENTRES = "centres AS (SELECT species, CAST(year % 5 AS INTEGER) AS cluster, sum(lon_e5) / count(*)::DOUBLE / 100000 AS x, sum(lat_e5) / count(*)::DOUBLE / 100000 AS y FROM occ GROUP BY 1, 2)"


@query(
    "jn_fold_nearest_centroid",
    with_views([V.OCC, CENTRES], """SELECT rec_id, species, cluster AS cv_fold FROM (SELECT rec_id, species, cluster, row_number() OVER (PARTITION BY rec_id
    ORDER BY (x - lon) * (x - lon) + (y - lat) * (y - lat), cluster) AS rn FROM occ JOIN centres USING (species)) WHERE rn = 1"""),
)
def jn_fold_nearest_centroid(spark, d):
    o = V.occ(spark, d)
    n = F.count(F.lit(1)).cast("double")
    centres = o.groupBy("species", (F.col("year") % 5).cast("int").alias("cluster")).agg(
        (F.sum("lon_e5").cast("double") / n / 100000.0).alias("x"), (F.sum("lat_e5").cast("double") / n / 100000.0).alias("y")
    )
    return FD.nearest_cluster(o.select("rec_id", "species", "lon", "lat"), centres).select("rec_id", "species", "cv_fold")


def presence_and_area(spark, d):
    pres = V.occ(spark, d).select("species", "lon", "lat")
    land = V.cells(spark, d).filter("land")
    area = SP.accessible_cells(pres, land)
    bg = SM.jitter(SM.sample_cells(area, ["species"], 200), V.grid(spark, d), ["species"]).select("species", "lon", "lat")
    return SM.presence_background(pres, bg)


@query("ml_spatial_folds")
def ml_spatial_folds(spark, d):
    t = FD.spatial_folds(presence_and_area(spark, d))
    return A.fold_balance(t)


@query("ml_reassign_folds")
def ml_reassign_folds(spark, d):
    """Folds with presences before (by year) and after clustering."""
    o = V.occ(spark, d).select("species", "lon", "lat", F.lit(1).alias("presence"), (F.col("year") % 3).cast("int").alias("cv_fold"))
    return FD.reassign(o)[1]


@query("ml_training_table")
def ml_training_table(spark, d):
    """Presences, accessible background, predictors, weights and folds of all species."""
    layers = V.cells(spark, d).join(V.bands_wide(spark, d), ["row", "col"], "left")
    plan = TR.TrainingPlan(grid=V.grid(spark, d), predictors=VARS, n_background=200)
    table, chosen = TR.build(V.occ(spark, d).select("species", "lon", "lat"), layers, plan)
    return table.groupBy("species", "presence", "cv_fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


def sim_sql(value: str, f: str, lo: str, hi: str) -> str:
    return f"""CASE WHEN {value} IS NULL THEN NULL WHEN {f} = 0 OR {value} < {lo} THEN CASE WHEN {hi} = {lo} THEN 0 ELSE ({value} - {lo}) / ({hi} - {lo}) * 100 END
      WHEN {f} <= 0.5 THEN 200 * {f} WHEN {f} < 1 THEN 200 * (1 - {f}) ELSE CASE WHEN {hi} = {lo} THEN 0 ELSE ({value} - {hi}) / ({hi} - {lo}) * 100 END END"""


STACK = "stacked AS (SELECT c.row, c.col, c.elevation, b.b1, b.b2 FROM cells c LEFT JOIN bands_wide b ON b.row = c.row AND b.col = c.col)"
LONG_REF = "long_ref AS (" + " UNION ALL ".join(f"SELECT species, '{v}' AS var, {v} AS v FROM env_ok" for v in VARS) + ")"
LONG_CELLS = "long_query AS (" + " UNION ALL ".join(f"SELECT row, col, '{v}' AS var, {v} AS v FROM stacked" for v in VARS) + ")"
MESS_CELLS = f"""mess_cells AS (SELECT row, col, min(sim) AS mess FROM (SELECT row, col, {sim_sql("v", "(n_le / n::DOUBLE)", "lo", "hi")} AS sim FROM (
  SELECT q.row, q.col, q.var, q.v, count(r.v) AS n_le, max(e.n) AS n, max(e.lo) AS lo, max(e.hi) AS hi FROM long_query q
  JOIN (SELECT var, count(*) AS n, min(v) AS lo, max(v) AS hi FROM long_ref GROUP BY var) e ON e.var = q.var
  LEFT JOIN long_ref r ON r.var = q.var AND r.v <= q.v GROUP BY 1, 2, 3, 4)) GROUP BY 1, 2)"""
MESS_VIEWS = [V.ENV, ENV_OK, STACK, LONG_REF, LONG_CELLS, MESS_CELLS]


def stacked(spark, d):
    b = V.bands_wide(spark, d).select("row", "col", "b1", "b2")
    return V.cells(spark, d).select("row", "col", "elevation").join(b, ["row", "col"], "left")


def cell_mess(spark, d):
    return ME.mess(V.env(spark, d).na.drop(subset=VARS), stacked(spark, d), VARS, [], ["row", "col"])


@query("m_mess", with_views(MESS_VIEWS, "SELECT row, col, round(mess, 6) AS mess FROM mess_cells"))
def m_mess(spark, d):
    return rounded(cell_mess(spark, d))


@query("m_mess_map", with_views(MESS_VIEWS, "SELECT c.row, c.col, round(coalesce(mess, -9999), 6) AS mess FROM cells c LEFT JOIN mess_cells m ON m.row = c.row AND m.col = c.col AND c.elevation IS NOT NULL"))
def m_mess_map(spark, d):
    values = cell_mess(spark, d).join(V.cells(spark, d).filter("elevation IS NOT NULL").select("row", "col"), ["row", "col"], "left_semi")
    return rounded(full_grid(V.cells(spark, d), values, nodata=S.RASTER_NODATA))


@query("ag_extrapolated_share", with_views(MESS_VIEWS, "SELECT round(count(*) FILTER (mess < 0) * 100::DOUBLE / count(mess), 6) AS pct_extrapolated, count(mess) AS n FROM mess_cells"))
def ag_extrapolated_share(spark, d):
    return rounded(cell_mess(spark, d).agg(ME.extrapolated().alias("pct_extrapolated"), F.count("mess").alias("n")))


LONG_OWN = "long_own AS (" + " UNION ALL ".join(f"SELECT rec_id, species, '{v}' AS var, {v} AS v FROM env" for v in VARS) + ")"
MESS_OWN = f"""mess_own AS (SELECT rec_id, species, min(sim) AS mess FROM (SELECT rec_id, species, {sim_sql("v", "(n_le / n::DOUBLE)", "lo", "hi")} AS sim FROM (
  SELECT q.rec_id, q.species, q.var, q.v, count(r.v) AS n_le, max(e.n) AS n, max(e.lo) AS lo, max(e.hi) AS hi FROM long_own q
  LEFT JOIN (SELECT species, var, count(*) AS n, min(v) AS lo, max(v) AS hi FROM long_ref GROUP BY 1, 2) e ON e.var = q.var AND e.species = q.species
  LEFT JOIN long_ref r ON r.var = q.var AND r.species = q.species AND r.v <= q.v GROUP BY 1, 2, 3, 4) WHERE n IS NOT NULL) GROUP BY 1, 2)"""


@query(
    "m_mess_summary",
    with_views(
        [V.ENV, ENV_OK, LONG_REF, LONG_OWN, MESS_OWN],
        """SELECT species, round(avg(mess), 6) AS mess_mean, round(min(mess), 6) AS mess_min, round(max(mess), 6) AS mess_max,
        round(CASE WHEN count(mess) > 0 THEN count(*) FILTER (mess < 0) * 100::DOUBLE / count(mess) END, 6) AS mess_pct_extrapolation, count(mess) AS n_points
        FROM env LEFT JOIN mess_own USING (rec_id, species) GROUP BY species""",
    ),
)
def m_mess_summary(spark, d):
    e = V.env(spark, d)
    return rounded(ME.summary(ME.mess(e.na.drop(subset=VARS), e, VARS, ["species"], ["rec_id"]), ["species"]))


MEDIANS = "ends AS (SELECT " + ", ".join(f"min({v}) AS lo_{v}, max({v}) AS hi_{v}, median({v}) AS md_{v}" for v in VARS) + " FROM env_ok)"


def median_sql(v: str) -> str:
    return f"""CASE WHEN {v} <= lo_{v} OR {v} >= hi_{v} THEN 0 WHEN {v} <= md_{v} THEN least(greatest(({v} - lo_{v}) / (md_{v} - lo_{v} + 1e-9::DOUBLE) * 100, 0), 100)
      ELSE least(greatest((hi_{v} - {v}) / (hi_{v} - md_{v} + 1e-9::DOUBLE) * 100, 0), 100) END"""


@query(
    "m_mess_median",
    with_views([V.ENV, ENV_OK, STACK, MEDIANS], f"SELECT row, col, round(CASE WHEN {COMPLETE} THEN least({', '.join(median_sql(v) for v in VARS)}) END, 6) AS mess FROM stacked, ends"),
)
def m_mess_median(spark, d):
    ref = V.env(spark, d).na.drop(subset=VARS).withColumn("map_id", F.lit("m"))
    q = stacked(spark, d).withColumn("map_id", F.lit("m"))
    return rounded(ME.mess_median(ref, q, VARS, ["map_id"], ["row", "col"]).drop("map_id"))


RANGES = "ranges AS (SELECT species, " + ", ".join(f"min({v}) AS lo_{v}, max({v}) AS hi_{v}" for v in VARS) + " FROM env_ok GROUP BY species)"
OUTSIDE = " OR ".join(f"coalesce({v} < lo_{v} OR {v} > hi_{v}, false)" for v in VARS)


@query(
    "m_range_extrapolation",
    with_views([V.ENV, ENV_OK, RANGES], f"SELECT species, round(count(*) FILTER ({OUTSIDE}) * 100::DOUBLE / count(*), 6) AS pct_outside FROM env JOIN ranges USING (species) GROUP BY species"),
)
def m_range_extrapolation(spark, d):
    e = V.env(spark, d)
    return rounded(ME.outside_range(e.na.drop(subset=VARS), e, VARS, ["species"]))


@query("w_ecdf", with_views([V.ENV, ENV_OK], "SELECT species, b1, (SELECT count(*) FROM env_ok r WHERE r.species = q.species AND r.b1 <= q.b1) AS n_at_or_below FROM (SELECT DISTINCT species, b1 FROM env_ok) q"))
def w_ecdf(spark, d):
    from habitspark.plans.scale import running_totals

    e = V.env(spark, d).na.drop(subset=VARS).groupBy("species", "b1").agg(F.count(F.lit(1)).alias("n"))
    return running_totals(e, ["species"], "b1", ["n"]).select("species", "b1", F.col("cum_n").alias("n_at_or_below"))
