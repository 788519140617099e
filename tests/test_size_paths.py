"""Both size paths of an operator give one answer on awkward rows."""

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import oracle
from habitspark.operators import folds, mess, metrics, models, sampling, selection, spatial
from habitspark.plans import scale
from habitspark.sources import polygons


def both_paths(spark, make):
    """Results at normal limits and at limits so low that everything counts as too big."""
    out = []
    for limits in ({}, oracle.TIGHT):
        for k, v in limits.items():
            spark.conf.set(k, v)
        try:
            out.append(make())
        finally:
            for k in limits:
                spark.conf.unset(k)
    return out


def test_points_with_repeated_keys_in_a_polygon(spark):
    square = [(1, 0, 0, 2, 0), (1, 2, 0, 2, 2), (1, 2, 2, 0, 2), (1, 0, 2, 0, 0)]
    edges = spark.createDataFrame([(a, float(b), float(c), float(d), float(e)) for a, b, c, d, e in square], "feature_id int, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1, 1.0, 1.0), (1, 1.0, 1.0), (1, 0.5, 1.5), (2, 5.0, 1.0), (3, None, 1.0)], "id int, lon double, lat double")

    def make():
        return (
            sorted(tuple(r) for r in spatial.covering(points, edges, ["id"]).collect()),
            spatial.inside_any(points, edges, ["id"]).count(),
        )

    small, large = both_paths(spark, make)
    assert small == large == ([(1, 1), (1, 1), (1, 1)], 3)


def test_similarity_of_repeated_and_missing_values(spark):
    ref = spark.createDataFrame([(float(v), float(10 - v)) for v in range(10)] + [(float("nan"), None)], "a double, b double")
    rows = [(7, 3.0, 4.0), (7, 100.0, 4.0), (7, 3.0, 4.0), (8, float("nan"), 5.0), (9, None, None), (None, 2.0, 2.0)]
    asked = spark.createDataFrame(rows, "id int, a double, b double")

    def make():
        got = mess.mess(ref, asked, ["a", "b"], [], ["id"]).collect()
        return sorted(((r["id"] is not None, r["id"]), (r["mess"] is not None, r["mess"])) for r in got)

    small, large = both_paths(spark, make)
    assert small == large
    assert len(small) == len(rows) and sum(m[0] for _, m in small) == 5


def test_quantiles_do_not_depend_on_size(spark):
    rng = np.random.default_rng(8)
    rows = [(f"g{k % 5}", float(v)) for k, v in enumerate(rng.random(503))] + [("g0", 0.25)] * 40 + [("g1", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    small, large = both_paths(spark, lambda: {tuple(r) for r in scale.exact_quantiles(df, ["g"], "v", {"p10": 0.1, "mid": 0.5}).collect()})
    assert small == large
    for g, p10, mid in small:
        own = [v for k, v in rows if k == g and v is not None]
        assert (p10, mid) == (pytest.approx(np.quantile(own, 0.1)), pytest.approx(np.quantile(own, 0.5)))


def test_omission_is_the_same_for_scores_on_the_threshold(spark):
    rows = [("a", k % 2, round(0.1 * (k % 11), 10)) for k in range(220)]
    df = spark.createDataFrame(rows, "g string, presence int, score double")
    small, large = both_paths(spark, lambda: [tuple(r) for r in metrics.omission_p10(df, ["g"]).collect()])
    assert small == large


def test_another_round_moves_no_centre(spark):
    rng = np.random.default_rng(3)
    rows = [("s", float(x), float(y), 1) for x, y in rng.normal(0, 3, (400, 2))]
    points = spark.createDataFrame(rows, "species string, lon double, lat double, presence int")
    centres, scaled = folds.presence_clusters(points, 5)
    at = folds.nearest_cluster(points, centres, scaled).join(scaled, "species")
    mean = at.groupBy("cv_fold").agg(F.avg(F.col("lon") * F.col("_scale")).alias("mx"), F.avg("lat").alias("my"))
    moved = mean.join(centres, F.col("cv_fold") == F.col("cluster")).select(F.greatest(F.abs(F.col("mx") - F.col("x")), F.abs(F.col("my") - F.col("y"))).alias("m"))
    assert moved.count() == 5 and moved.agg(F.max("m")).first()[0] < 1e-3


def test_correlation_rule_on_all_small_cases(spark):
    """The rule in words, on drawn matrices: runs of a first feature that was there when they began."""
    names = [f"f{i}" for i in range(5)]
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for n in range(60):
        r, var = rng.uniform(-1, 1, 10).round(2), rng.integers(1, 4, 5).astype(float)
        rows.append((n, [float(v) for v in var], [float(v) if n % 7 else None for v in r]))
        gone: list = []
        pair = {p: r[k] for k, p in enumerate((a, b) for a in range(5) for b in range(a + 1, 5))}
        for a in range(5):
            present = a not in gone
            for b in range(a + 1, 5):
                if present and n % 7 and b not in gone and abs(pair[a, b]) > 0.5:
                    loser = b if var[a] >= var[b] else a
                    gone = gone if loser in gone else [*gone, loser]
        want[n] = [i for i in range(5) if i not in gone]
    df = spark.createDataFrame(rows, "n int, var array<double>, r array<double>")
    got = {x["n"]: list(x["kept"]) for x in df.select("n", selection.uncorrelated(names, 0.5).alias("kept")).collect()}
    assert got == want


def test_more_draws_than_cells(spark):
    cells = spark.createDataFrame([(0, 0, 3), (0, 1, 1)], "row long, col long, effort long")
    got = sampling.sample_by_effort(cells, 4000).groupBy("row", "col").count().collect()
    share = {r["col"]: r["count"] for r in got}
    assert sum(share.values()) == 4000 and 0.7 < share[0] / 4000 < 0.8
    assert sampling.sample_by_effort(cells.limit(0), 10).collect() == []


def test_broken_layer_is_no_absent_layer(spark, tmp_path):
    assert polygons.read_polygons(spark, str(tmp_path / "nowhere")) is None
    (tmp_path / "empty").mkdir()
    with pytest.raises(AnalysisException):
        polygons.read_polygons(spark, str(tmp_path / "empty"))


def test_overlay_of_settings(spark):
    rows = [("rf", "numTrees", "50"), ("maxent", "features", "linear,product"), ("maxent", "clamp", "false"), ("glm", "C", "0.25")]
    table = spark.createDataFrame(rows, "algo string, parameter string, value string")
    assert models.read_overlay(table) == {"rf": {"numTrees": 50}, "maxent": {"features": ("linear", "product"), "clamp": False}, "glm": {"C": 0.25}}
    for wrong in (("gbm", "num_leaves", "31"), ("tree", "depth", "2")):
        with pytest.raises(ValueError, match=wrong[1] if wrong[0] == "gbm" else "tree"):
            models.read_overlay(spark.createDataFrame([wrong], "algo string, parameter string, value string"))


def test_status_names_what_failed():
    status: list = []

    def broken():
        raise ValueError("no variation")

    assert models.attempt(lambda: 5, status, 1, "glm") == 5 and models.attempt(broken, status, 1, "rf") is None
    assert status == [(1, "glm", "ok", ""), (1, "rf", "failed", "no variation")]
    with pytest.raises(TypeError):
        models.attempt(lambda: len(3), status, 1, "gbm")


def test_folds_are_judged_in_one_pass(spark):
    """Thresholds of the other folds, AUC and TSS as from rows copied per fold, with a fold of one class and one score for all."""
    rng = np.random.default_rng(4)
    rows = [(f"g{k % 3}", int(rng.integers(0, 3)), int(rng.random() < 0.4), float(rng.integers(0, 12)) / 12) for k in range(400)]
    rows += [("one", 0, 1, 0.5), ("one", 1, 0, 0.5), ("one", 1, 1, 0.5), ("single", 2, 1, 0.1), ("single", 2, 0, 0.2), ("g0", 1, 1, None)]
    df = spark.createDataFrame(rows, "g string, cv_fold int, presence int, score double")
    asked: list[int] = []

    def make():
        real, scale_rows = metrics.running_totals, []
        metrics.running_totals = lambda *a, **k: (scale_rows.append(1), real(*a, **k))[1]
        try:
            out = metrics.cross_fold_metrics(df, ["g"], "cv_fold", range(3))
        finally:
            metrics.running_totals = real
        asked.append(len(scale_rows))
        return sorted((r["g"], r["cv_fold"], round(r["auc"], 9), round(r["tss"], 9)) for r in out.collect())

    want = []
    for f in range(3):
        limits = metrics.max_tss_roc(df.filter(F.col("cv_fold") != f), ["g"])
        for r in metrics.fold_metrics(df.filter(F.col("cv_fold") == f), ["g"], "cv_fold", limits).collect():
            want.append((r["g"], f, round(r["auc"], 9), round(r["tss"], 9)))
    want = sorted(w for w in want if w[0] != "single")  # no rows outside its fold, so no threshold
    small, large = both_paths(spark, make)
    assert small == large == want
    assert asked == [1, 1]


def test_summary_reads_its_scores_once(spark, monkeypatch):
    from habitspark.operators import workflow

    rng = np.random.default_rng(2)
    rows = [(f"s{k % 2}", k % 3, int(rng.random() < 0.4), *[float(v) for v in rng.random(6)]) for k in range(300)] + [("bare", 0, 0, *[0.5] * 6)]
    df = spark.createDataFrame(rows, "species string, cv_fold int, presence int, glm double, gam double, rf double, gbm double, maxent double, ensemble double")
    tables = []
    real = metrics.roc_table
    monkeypatch.setattr(metrics, "roc_table", lambda d, keys, *a: (tables.append(tuple(keys)), real(d, keys, *a))[1])
    got = {r["species"]: r for r in workflow.species_summary(df, spread=False).collect()}
    assert sorted(tables) == [("species",), ("species", "cv_fold")]
    assert "algo_sd_mean" in workflow.species_summary(df).columns
    want = {r["species"]: r for r in metrics.thresholds(df.withColumn("score", F.col("ensemble")), ["species"]).collect()}
    assert {k: (v["maxTSS"], v["p10"]) for k, v in want.items()} == {k: (v["maxTSS"], v["p10"]) for k, v in got.items()}


def test_many_groups_are_dealt_to_many_tasks(spark, monkeypatch):
    df = spark.range(1000).selectExpr("id % 400 AS k", "id AS v")
    assert scale.dealt(df, ["k"], 400).rdd.getNumPartitions() == df.rdd.getNumPartitions()
    monkeypatch.setattr(scale, "TASK_GROUPS", 10)
    much = scale.dealt(df, ["k"], 400)
    assert much.rdd.getNumPartitions() == 40
    held = much.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("k").alias("n")).agg(F.max("n")).first()[0]
    assert held < 40
    assert much.groupBy("k").agg(F.sum("v").alias("s")).exceptAll(df.groupBy("k").agg(F.sum("v").alias("s"))).isEmpty()


def test_bands_of_cells_are_one_sum(spark, monkeypatch):
    """One exchange for the lines of a cell, none for bands that nobody reads; many cells give as many tasks as they need."""
    from habitspark.suite import views

    folder = "/root/testdata/sf0.001"
    few = sorted(map(tuple, views.bands_wide(spark, folder).collect()), key=lambda r: r[:2])
    plan = views.bands_wide(spark, folder).select("row", "col", "b1")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "= 2" not in plan
    monkeypatch.setattr(scale, "TASK_GROUPS", 20)
    wide = views.bands_wide(spark, folder)
    assert wide.rdd.getNumPartitions() >= 50
    assert sorted(map(tuple, wide.collect()), key=lambda r: r[:2]) == few
