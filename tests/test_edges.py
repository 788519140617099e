"""Edge cases and brute-force comparisons on small inputs."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from habitspark import settings as S
from habitspark.functions import geo, text
from habitspark.operators import cleaning, ensemble, folds, importance, mess, metrics, models, raster, sampling, selection, spatial
from habitspark.operators import tables, workflow
from habitspark.plans import proximity, scale
from habitspark.sources import occurrences, rasters


def scores(spark, rows):
    return spark.createDataFrame(rows, "g string, presence int, score double")


def one(df):
    return df.collect()[0]


def test_auc_cases(spark):
    df = scores(
        spark,
        [("ties", 1, 0.5), ("ties", 0, 0.5), ("single", 1, 0.2), ("single", 1, 0.9), ("best", 1, 0.9), ("best", 0, 0.1),
         ("mixed", 1, 0.8), ("mixed", 0, 0.8), ("mixed", 0, 0.2), ("mixed", 1, None)],
    )
    got = {r["g"]: r["auc"] for r in metrics.auc(df, ["g"]).collect()}
    assert got == {"ties": 0.5, "single": None, "best": 1.0, "mixed": 0.75}


def test_reversed_scores_mirror_auc(spark):
    rng = np.random.default_rng(1)
    df = scores(spark, [("a", int(p), float(s)) for p, s in zip(rng.integers(0, 2, 300), rng.integers(0, 40, 300) / 40)])
    a = one(metrics.auc(df, ["g"]))["auc"]
    b = one(metrics.auc(df.withColumn("score", 1 - F.col("score")), ["g"]))["auc"]
    assert math.isclose(a, 1 - b)


def test_threshold_tie_rules(spark):
    # 0.2..0.6 separate the classes equally well
    df = scores(spark, [("a", 0, 0.1), ("a", 1, 0.9), ("a", 0, 0.5), ("a", 1, 0.4)])
    assert one(metrics.max_tss_roc(df, ["g"]))["threshold"] == 0.9
    assert one(metrics.max_tss_sweep(df, ["g"]))["threshold"] == 0.4
    worst = scores(spark, [("a", 1, 0.1), ("a", 0, 0.9)])
    assert one(metrics.max_tss_roc(worst, ["g"]))["threshold"] == float("inf")
    single = one(metrics.max_tss_sweep(scores(spark, [("a", 1, 0.3)]), ["g"]))
    assert (single["threshold"], single["tss"]) == (0.5, 0.0)


def test_flat_scores_have_no_boyce(spark):
    df = scores(spark, [("a", i % 2, 0.5) for i in range(20)])
    assert one(metrics.boyce_range(df, ["g"]))["boyce"] is None
    assert one(metrics.boyce_unit(df, ["g"]))["boyce"] is None
    assert one(metrics.calibration_line(df, ["g"]))["calib_slope"] is None


def test_unit_bins_share_edges(spark):
    edges = metrics.boyce_unit_edges()
    assert len(edges) == 20 and edges[0][0] == 0.0
    assert len(metrics.boyce_unit_edges(bin_width=0.1)) == 10


def test_quantiles_on_both_paths(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 30, 200).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"g": ["a"] * 120 + ["b"] * 80, "v": x}))
    probs = {"p10": 0.1, "mid": 0.5, "top": 1.0}
    want = {g: [np.percentile(v, 100 * p) for p in probs.values()] for g, v in (("a", x[:120]), ("b", x[120:]))}
    for limit in ("1000000", "10"):
        spark.conf.set(scale.GROUP_ROWS_CONF, limit)
        got = {r["g"]: [r[n] for n in probs] for r in scale.exact_quantiles(df, ["g"], "v", probs).collect()}
        assert got.keys() == want.keys()
        assert all(np.allclose(got[g], want[g]) for g in want)
    spark.conf.unset(scale.GROUP_ROWS_CONF)


def test_take_smallest_on_both_paths(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), "id", scale.hash_unit(F.col("id")).alias("draw"))
    plain = {r["id"] for r in scale.take_smallest(df, ["g"], "draw", 300, ["id"]).collect()}
    spark.conf.set(scale.GROUP_ROWS_CONF, "10")
    split = {r["id"] for r in scale.take_smallest(df, ["g"], "draw", 300, ["id"]).collect()}
    spark.conf.unset(scale.GROUP_ROWS_CONF)
    assert plain == split and len(plain) == 600


def test_join_hot_equals_join(spark, tight):
    big = spark.range(400).select((F.when(F.col("id") < 300, 7).otherwise(F.col("id"))).cast("long").alias("k"), "id")
    lookup = spark.range(0, 500, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    lookup = lookup.unionByName(spark.createDataFrame([(7, 99)], "k long, v long"))
    want = sorted(map(str, big.join(lookup, ["k"], "left").collect()))
    assert sorted(map(str, scale.join_hot(big, lookup, ["k"], "left").collect())) == want


def haversine(lon1, lat1, lon2, lat2):
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * S.EARTH_KM * np.arcsin(np.sqrt(h))


@pytest.mark.parametrize("lat0,lon0", [(-30.0, -70.0), (68.0, 10.0), (0.0, 179.5)])
def test_distance_joins_equal_brute_force(spark, lat0, lon0):
    rng = np.random.default_rng(3)
    pts = pd.DataFrame({"species": rng.choice(["a", "b"], 80), "lon": lon0 + rng.uniform(-3, 3, 80), "lat": lat0 + rng.uniform(-3, 3, 80)})
    pts["lon"] = (pts["lon"] + 180) % 360 - 180
    rows, cols = np.divmod(np.arange(900), 30)
    cells = pd.DataFrame({"row": rows, "col": cols, "lon": (lon0 - 9 + cols * 0.6 + 180) % 360 - 180, "lat": lat0 + 9 - rows * 0.6})
    cells = cells[cells["lat"].abs() < 90]
    sp, sc = spark.createDataFrame(pts), spark.createDataFrame(cells)
    want = {}
    for name, g in pts.groupby("species"):
        d = haversine(g["lon"].to_numpy()[:, None], g["lat"].to_numpy()[:, None], cells["lon"].to_numpy(), cells["lat"].to_numpy()).min(axis=0)
        want.update({(name, r, c): x for r, c, x in zip(cells["row"], cells["col"], d) if x <= 300})
    near = {(r["species"], r["row"], r["col"]): r["distance_km"] for r in proximity.nearest(sp, sc, ["species"], 300.0).collect()}
    assert near.keys() == want.keys()
    assert all(math.isclose(near[k], want[k], abs_tol=1e-6) for k in want)
    inside = [(r["species"], r["row"], r["col"]) for r in proximity.within(sp, sc, ["species"], 300.0).collect()]
    assert len(inside) == len(set(inside)) and set(inside) == want.keys()


def test_short_geodesic(spark):
    # a minute of latitude on the ellipsoid at 45 degrees, and of longitude on the equator
    r = one(spark.range(1).select(
        geo.ellipsoid_m(F.lit(0.0), F.lit(45.0 - 1 / 120), F.lit(0.0), F.lit(45.0 + 1 / 120)).alias("a"),
        geo.ellipsoid_m(F.lit(0.0), F.lit(0.0), F.lit(1 / 60), F.lit(0.0)).alias("b"),
    ))
    assert abs(r["a"] - 1852.2) < 0.3 and abs(r["b"] - 1855.325) < 0.01


def test_hull_of_few_or_straight_points(spark):
    rows = [("two", 0.0, 0.0), ("two", 1.0, 1.0)] + [("line", float(i), float(i)) for i in range(5)]
    rows += [("box", float(x), float(y)) for x in range(3) for y in range(3)]
    hull = spatial.convex_hull(spark.createDataFrame(rows, "species string, lon double, lat double"))
    n = {r["species"]: r["count"] for r in hull.groupBy("species").count().collect()}
    assert n == {"two": 2, "line": 2, "box": 4}
    grid = geo.Grid(-0.5, 2.5, 1.0, 1.0, 3, 3)
    cells = spark.range(9).select(F.floor(F.col("id") / 3).alias("row"), (F.col("id") % 3).alias("col"))
    held = {(r["species"], r["row"], r["col"]) for r in spatial.cells_in_hull(hull, cells, grid).collect()}
    assert held == {("box", r, c) for r in range(3) for c in range(3)}


def test_terrain_window(spark):
    grid = geo.Grid(0.0, 3.0, 1.0, 1.0, 3, 3)
    flat = spark.range(9).select(F.floor(F.col("id") / 3).alias("row"), (F.col("id") % 3).alias("col"), F.lit(5.0).alias("elevation"))
    for r in raster.terrain(flat, grid).collect():
        assert (r["slope"], r["aspect"], r["northness"], r["eastness"]) == (0.0, None, 0.0, 0.0)
    ramp = flat.withColumn("elevation", F.col("col") * 1000.0)  # rises to the east, so it faces west
    for r in raster.terrain(ramp, grid).collect():
        assert r["slope"] > 0 and abs(r["aspect"] - 270.0) < 1e-9
    hole = ramp.withColumn("elevation", F.when((F.col("row") != 1) | (F.col("col") != 1), F.col("elevation")))
    t = {(r["row"], r["col"]): r for r in raster.terrain(hole, grid).collect()}
    assert t[1, 1]["slope"] is None and t[1, 1]["northness"] == 0.0
    # the missing neighbour of the corner counts as the corner's own height
    assert 0 < t[0, 0]["slope"] < 0.3


def test_mess_equals_brute_force_on_both_paths(spark):
    rng = np.random.default_rng(4)
    ref = pd.DataFrame({"a": rng.integers(0, 9, 40).astype(float), "b": rng.normal(size=40), "c": 3.0})
    q = pd.DataFrame({"id": range(60), "a": rng.integers(-3, 12, 60).astype(float), "b": rng.normal(size=60) * 2, "c": rng.choice([2.0, 3.0, 4.0], 60)})
    q.loc[::7, "b"] = np.nan

    def similarity(v, r):
        f, lo, hi = (r <= v).mean(), r.min(), r.max()
        if f == 0 or v < lo:
            return 0.0 if hi == lo else (v - lo) / (hi - lo) * 100
        if f <= 0.5:
            return 200 * f
        if f < 1:
            return 200 * (1 - f)
        return 0.0 if hi == lo else (v - hi) / (hi - lo) * 100

    want = {int(r["id"]): min(similarity(r[v], ref[v].to_numpy()) for v in "abc" if not np.isnan(r[v])) for _, r in q.iterrows()}
    sr = spark.createDataFrame(ref)
    sq = occurrences.no_nan(spark.createDataFrame(q))
    for limit in ("67108864", "1"):
        spark.conf.set(scale.BROADCAST_BYTES_CONF, limit)
        got = {r["id"]: r["mess"] for r in mess.mess(sr, sq, ["a", "b", "c"], [], ["id"]).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    spark.conf.unset(scale.BROADCAST_BYTES_CONF)


def test_vif_equals_regression():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50, 4))
    x[:, 3] = x[:, 0] + x[:, 1] + rng.normal(size=50) * 0.1
    want = []
    for j in range(4):
        o = np.column_stack([np.ones(50), np.delete(x, j, 1)])
        res = x[:, j] - o @ np.linalg.lstsq(o, x[:, j], rcond=None)[0]
        want.append(1 / (res @ res / ((x[:, j] - x[:, j].mean()) ** 2).sum()))
    assert np.allclose(selection.inflation(np.corrcoef(x, rowvar=False)), want)
    assert np.isinf(selection.inflation(np.ones((2, 2)))).all()


def test_predictor_choice(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=80), rng.normal(size=80)
    df = pd.DataFrame({"species": "x", "a": a, "twice": 2 * a + 0.01 * b, "b": b, "const": 1.0})
    got = selection.select_predictors(spark.createDataFrame(df), ["a", "twice", "b", "const"], ["species"]).orderBy("position")
    assert [r["predictor"] for r in got.collect()] == ["twice", "b", "const"]


def test_folds_are_disjoint_and_hold_presences(spark):
    rng = np.random.default_rng(7)
    centres = np.array([[0, 0], [10, 0], [0, 10], [10, 10], [5, 5]], float)
    p = np.vstack([c + rng.normal(size=(20, 2)) * 0.3 for c in centres])
    df = pd.DataFrame({"species": "x", "presence": 1, "lon": p[:, 0], "lat": p[:, 1]})
    bg = pd.DataFrame({"species": "x", "presence": 0, "lon": rng.uniform(-2, 12, 100), "lat": rng.uniform(-2, 12, 100)})
    few = pd.DataFrame({"species": "y", "presence": 1, "lon": [1.0, 1.0, 2.0], "lat": [1.0, 1.0, 2.0]})
    alone = pd.DataFrame({"species": "z", "presence": 0, "lon": [1.0], "lat": [1.0]})
    t = folds.spatial_folds(spark.createDataFrame(pd.concat([df, bg, few, alone])))
    got = t.toPandas()
    x = got[(got.species == "x") & (got.presence == 1)]
    assert x.groupby("cv_fold").size().tolist() == [20] * 5
    assert got[got.species == "y"].cv_fold.nunique() == 2
    assert got[got.species == "z"].cv_fold.tolist() == [0]
    assert len(got) == 204


def test_case_weights_balance(spark):
    df = spark.createDataFrame([("a", 1)] * 3 + [("a", 0)] * 12, "species string, presence int")
    w = {r["presence"]: r["s"] for r in sampling.case_weights(df).groupBy("presence").agg(F.sum("weight").alias("s")).collect()}
    assert math.isclose(w[0], w[1])
    with pytest.raises(ValueError):
        sampling.case_weights(df, "other")


def test_effort_draws_follow_effort(spark):
    cells = spark.range(200).select(F.lit(0).cast("long").alias("row"), F.col("id").alias("col"), F.when(F.col("id") == 5, 400).otherwise(2).alias("effort"))
    n = sampling.sample_by_effort(cells, 200)
    assert n.count() == 200
    share = n.filter("col = 5").count() / 200
    assert 0.35 < share < 0.65


def test_sample_takes_all_when_short(spark):
    area = spark.range(10).select(F.lit("a").alias("species"), F.col("id").alias("row"), F.col("id").alias("col"))
    assert sampling.sample_cells(area, ["species"], 50).count() == 10
    assert sampling.sample_cells(area, ["species"], 4).count() == 4


def test_shuffled_predictor_keeps_its_values(spark):
    df = spark.range(50).select("id", (F.col("id") * 2).alias("a"), (F.col("id") * 3).alias("b"), F.lit(1).alias("presence"))
    p = importance.permuted(df, ["id"], ["a", "b"], 2).toPandas()
    assert len(p) == 200
    for _, g in p[p.variable == "a"].groupby("repeat"):
        assert sorted(g["a"]) == [2 * i for i in range(50)] and (g["b"] == 3 * g["id"]).all() and (g["a"] != 2 * g["id"]).any()


def test_failed_algorithm_leaves_ensemble(spark):
    w = spark.createDataFrame([("x", "glm", 0.5), ("x", "rf", 0.0)], "species string, algo string, weight double")
    s = spark.createDataFrame([("x", 0.4, None, 0.9, None, None), ("x", None, None, 0.9, None, None)],
                              "species string, glm double, gam double, rf double, gbm double, maxent double")
    assert [r["ensemble"] for r in ensemble.with_ensemble(s, w).collect()] == [0.4, None]


def test_equal_weights_when_none_scores(spark):
    cv = spark.createDataFrame([("x", "glm", -0.2), ("x", "rf", 0.0)], "species string, algo string, tss double")
    assert {r["weight"] for r in ensemble.tss_weights(cv).collect()} == {1.0}
    assert {r["weight"] for r in ensemble.equal_weights_above(cv).collect()} == {0.5}


def test_models_separate_classes(spark):
    rng = np.random.default_rng(8)
    y = (np.arange(300) < 60).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"presence": y, "a": rng.normal(size=300) + 2 * y, "b": rng.normal(size=300)}))
    light = {"rf": {"numTrees": 10, "maxDepth": 4}, "gbm": {"maxIter": 3}, "gam": {"n_splines": 6}}
    for algo in S.ALGORITHMS:
        scored = models.fit(df, ["a", "b"], algo, light).score(df).withColumn("g", F.lit(0))
        assert one(metrics.auc(scored, ["g"], algo))["auc"] > 0.85, algo
        ends = one(scored.agg(F.min(algo).alias("lo"), F.max(algo).alias("hi")))
        assert 0.0 <= ends["lo"] <= ends["hi"] <= 1.0


def test_every_species_is_validated_with_its_predictors(spark):
    rng = np.random.default_rng(9)
    rows = []
    for name, n in (("x", 60), ("y", 60), ("alone", 8)):
        y = np.arange(n) % 2
        rows.append(pd.DataFrame({"species": name, "presence": y, "cv_fold": 0 if name == "alone" else np.arange(n) % 4 // 2,
                                  "a": rng.normal(size=n) + 3 * y, "b": rng.normal(size=n)}))
    chosen = spark.createDataFrame([("x", "a", 0), ("y", "a", 0), ("y", "b", 1), ("alone", "a", 0)], "species string, predictor string, position int")
    oof = workflow.cross_validate_species(spark.createDataFrame(pd.concat(rows)), chosen, ["glm"])
    got = {(r["species"], r["held_out"], r["split"]): r["count"] for r in oof.groupBy("species", "held_out", "split").count().collect()}
    assert got == {(s, k, t): 30 for s in "xy" for k in (0, 1) for t in ("train", "test")}
    _, _, per_fold = workflow.per_fold_scores(oof, ["glm"])
    assert all(r["auc"] > 0.9 for r in per_fold.collect())


def test_scope_method_must_be_known(spark):
    df = spark.createDataFrame([("Chile", -70.0, -30.0), (None, -70.0, -30.0)], "country string, lon double, lat double")
    assert cleaning.scope(df, "country").count() == 1
    with pytest.raises(ValueError):
        cleaning.scope(df, "elsewhere")


def test_slug_and_missing_name_column(spark):
    r = one(spark.range(1).select(text.slug(F.lit("  Nolana var. x ")).alias("s"), text.unslug(F.lit("nolana_rostrata")).alias("u")))
    assert (r["s"], r["u"]) == ("nolana_var_x", "Nolana Rostrata")
    with pytest.raises(KeyError):
        tables.records_of_slug(spark.range(1), spark.range(1))


def test_nodata_becomes_null(spark):
    df = spark.createDataFrame([(1.0,), (-9999.0,), (float("nan"),), (-3.4e38,)], "v double")
    assert [r[0] for r in df.select(rasters.valid_value(F.col("v"))).collect()] == [1.0, None, None, None]


def test_missing_layers(spark):
    with pytest.raises(KeyError):
        raster.stack(spark.range(1), ["a"], ["b"])
    with pytest.raises(ValueError):
        raster.mosaic([None], "v")
