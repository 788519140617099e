"""Model fits, evaluation, prediction, projection and importance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitspark import settings as S
from habitspark.functions.geo import in_bbox
from habitspark.operators import boosting as BO
from habitspark.operators import bundle as BU
from habitspark.operators import ensemble as E
from habitspark.operators import folds as FD
from habitspark.operators import importance as IM
from habitspark.operators import linear as LI
from habitspark.operators import mess as ME
from habitspark.operators import metrics as M
from habitspark.operators import models as MD
from habitspark.operators import scenarios as SC
from habitspark.operators import training as TR
from habitspark.operators import workflow as W
from habitspark.sources import rasters, sinks
from habitspark.plans.scale import stored
from habitspark.suite import views as V
from habitspark.suite import spatial as _spatial  # noqa: F401  registers ml_eoo
from habitspark.suite.metrics import BOYCE_UNIT, ENS, RANKED, TRAIN_BEST, WEIGHTS, fold_table, rounded
from habitspark.suite.modelling import COMPLETE, ENV_OK, VARS
from habitspark.suite.registry import SQL, query
from habitspark.suite.spatial import DISTANCES
from habitspark.suite.views import with_views

# Fewer trees and rounds than in production keep the checks short; the rows are all used.
LIGHT = {
    "glm": {"maxIter": 50},
    "gam": {"n_splines": 8, "maxIter": 50},
    "rf": {"numTrees": 20, "maxDepth": 5, "minInstancesPerNode": 2},
    "gbm": {"maxIter": 5, "stepSize": 0.3, "maxDepth": 3, "minInstancesPerNode": 2},
    "maxent": {"maxIter": 50},
}
P = V.FEATURES


def training(spark, d):
    return FD.spatial_folds(V.features(spark, d))


def in_unit(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def one_species(spark, d):
    """Rows of ``features`` as a training table, all predictors chosen."""
    chosen = spark.createDataFrame([("Species e", i, p) for i, p in enumerate(P)], "species string, position int, predictor string")
    return V.features(spark, d).withColumn("cv_fold", F.lit(0)), chosen


def fitted_scores(spark, d, algo, overrides=None):
    """Scores by one algorithm, fitted to all rows with its full settings."""
    t, chosen = one_species(spark, d)
    if algo == "gbm":
        scored = BO.score_boosted(t, BO.fit_boosted(t, chosen, P, folds=False), P)
    else:
        scored = LI.score_models(t, LI.fit_linear(t, chosen, P, [algo], overrides, folds=False), P, [algo])
    return in_unit(scored.select("row_id", "presence", algo), algo)


@query("ml_glm")
def ml_glm(spark, d):
    return fitted_scores(spark, d, "glm")


@query("ml_gam")
def ml_gam(spark, d):
    return fitted_scores(spark, d, "gam")


@query("ml_rf")
def ml_rf(spark, d):
    """A forest of 300 trees of full depth."""
    t = V.features(spark, d)
    return in_unit(MD.fit(t, P, "rf").score(t).select("row_id", "presence", "rf"), "rf")


@query("ml_gbm")
def ml_gbm(spark, d):
    return fitted_scores(spark, d, "gbm")


@query("ml_maxent")
def ml_maxent(spark, d):
    return fitted_scores(spark, d, "maxent")


@query("ml_maxent_lown")
def ml_maxent_lown(spark, d):
    """Strongly regularised fit for small species, with its confidence label."""
    return fitted_scores(spark, d, "maxent", {"maxent": MD.LOW_N_MAXENT}).withColumn("confidence", F.lit("BAJA"))


@query("ml_algo_isolation")
def ml_algo_isolation(spark, d):
    """A failing algorithm leaves its column null and drops out of the ensemble."""
    t = V.features(spark, d)
    models = MD.fit_all(t, P, ["glm", "rf", "unknown"], LIGHT)
    weights = spark.createDataFrame([("Species e", a, 0.5) for a in S.ALGORITHMS], "species string, algo string, weight double")
    return in_unit(E.with_ensemble(MD.score_all(models, t), weights).select("row_id", "glm", "gam", "rf", "ensemble"), "glm", "rf", "ensemble")


def _values(rows) -> str:
    return ", ".join(f"('{a}', '{k}', $${v}$$)" for a, k, v in rows)


PLAIN = [(a, k, str(v)) for a in MD.DEFAULTS for k, v in MD.parameters(a).items()]
TUNED = [(a, k, str(v)) for a, settings in MD.TUNED.items() for k, v in settings.items()]


@query(
    "ml_tuned_params",
    f"""WITH customers AS (SELECT n_regionkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
    tuned AS (SELECT list_extract({list(S.ALGORITHMS)}, n_regionkey + 1) AS algo FROM customers WHERE n >= (SELECT avg(n) FROM customers)),
    plain AS (SELECT * FROM (VALUES {_values(PLAIN)}) AS t(algo, parameter, value)), own AS (SELECT * FROM (VALUES {_values(TUNED)}) AS t(algo, parameter, value))
    SELECT p.algo, p.parameter, coalesce(o.value, p.value) AS value, o.value IS NOT NULL AS is_tuned FROM plain p
    LEFT JOIN own o ON o.algo = p.algo AND o.parameter = p.parameter AND o.algo IN (SELECT algo FROM tuned)""",
)
def ml_tuned_params(spark, d):
    """Settings in force when a table selects which algorithms are tuned: one region stands for each."""
    customers = spark.read.parquet(f"{d}/customer.parquet").join(spark.read.parquet(f"{d}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey"))
    n = customers.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))
    algo = F.element_at(F.lit(list(S.ALGORITHMS)), (F.col("n_regionkey") + 1).cast("int"))
    tuned = n.join(n.agg(F.avg("n").alias("mean")), F.col("n") >= F.col("mean")).select(algo.alias("algo"))  # a single mean
    settings = spark.createDataFrame(TUNED, "algo string, parameter string, value string").join(tuned, "algo", "left_semi")
    overlay = MD.read_overlay(settings)
    own = settings.select("algo", "parameter", F.lit(True).alias("is_tuned"))
    in_force = MD.parameter_table(spark, overlay).join(own, ["algo", "parameter"], "left")
    return in_force.select("algo", "parameter", "value", F.coalesce("is_tuned", F.lit(False)).alias("is_tuned"))


@query("ml_fit_full")
def ml_fit_full(spark, d):
    """All algorithms on all rows and their mean score per class."""
    t = V.features(spark, d)
    scored = MD.score_all(MD.fit_all(t, P, overrides=LIGHT), t)
    return scored.groupBy("presence").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(a), 4).alias(a) for a in S.ALGORITHMS])


def oof(spark, d, algorithms=tuple(S.ALGORITHMS)):
    return MD.cross_validate(training(spark, d), P, algorithms, LIGHT)


@query("ml_spatial_cv")
def ml_spatial_cv(spark, d):
    long, _, folds = W.per_fold_scores(oof(spark, d, ["glm", "rf", "maxent"]), ["glm", "rf", "maxent"])
    return folds.select("species", "algo", "held_out", F.round("auc", 4).alias("auc"), F.round("tss", 4).alias("tss"))


@query("ml_ensemble_metrics")
def ml_ensemble_metrics(spark, d):
    """Full evaluation row of the five algorithms and their ensemble, for one species."""
    _, full, _ = W.evaluate(oof(spark, d), P)
    return full.withColumns({n: F.round(n, 4) for n, t in full.dtypes if t == "double"})


def trained(spark, d):
    t = V.features(spark, d)
    models = MD.fit_all(t, P, ["glm", "maxent"], LIGHT)
    weights = spark.createDataFrame([("Species e", "glm", 0.4), ("Species e", "maxent", 0.6)], "species string, algo string, weight double")
    return models, weights


# forests are Spark ML fits one by one, minutes for all species and folds (README), so these queries run the other four, in full
WHOLE = [a for a in S.ALGORITHMS if a != "rf"]


def whole_run(spark, d):
    """Training table of all species (background: all accessible cells up to 10 000), all models, and cross-validated scores."""
    layers = V.cells(spark, d).join(V.bands_wide(spark, d), ["row", "col"], "left").select("row", "col", "lon", "lat", "land", *VARS)
    layers = stored(layers)
    built = TR.build(V.occ(spark, d).select("species", "lon", "lat"), layers, TR.TrainingPlan(grid=V.grid(spark, d), predictors=VARS))
    training, chosen = stored(built[0]), stored(built[1])
    trained = W.train_species(training, chosen, VARS, forests=False)
    return layers, training, trained, W.cross_scores(training, trained)


AREA_ENV = "area_env AS (SELECT species, a.row, a.col, c.elevation, b.b1, b.b2 FROM distances a JOIN cells c ON c.row = a.row AND c.col = a.col LEFT JOIN bands_wide b ON b.row = a.row AND b.col = a.col WHERE distance_km <= 300)"


@query(
    "ml_ensemble_train",
    with_views(
        [V.ENV, ENV_OK, DISTANCES, AREA_ENV],
        f"""SELECT p.species, p.n_pres, coalesce(b.n_bg, 0) AS n_bg, CASE WHEN p.r <= 0.7 THEN 3 END AS n_pred, p.folds AS n_folds, 4 * (p.folds + 1) AS n_fits, 0 AS n_failed,
        'ok' AS status, true AS metrics_in_range, CAST(p.n_pres + coalesce(b.n_bg, 0) AS BIGINT) AS n_tested
        FROM (SELECT species, count(*) AS n_pres, least(5, count(DISTINCT (lon, lat))) AS folds, greatest(abs(corr(elevation, b1)), abs(corr(elevation, b2)), abs(corr(b1, b2))) AS r FROM env_ok GROUP BY species) p
        LEFT JOIN (SELECT species, count(*) AS n_bg FROM area_env WHERE {COMPLETE} GROUP BY species) b ON b.species = p.species""",
    ),
)
def ml_ensemble_train(spark, d):
    """Whole run of all species: four algorithms, spatial folds, ensemble. One row per species with its counts and state.

    ``n_tested`` counts the rows that some fold left out and scored; ``metrics_in_range`` says that AUC and TSS of all algorithms and
    of the ensemble exist and lie where they can lie. The metrics themselves come from ``workflow.evaluate``.
    """
    _, training, trained, oof = whole_run(spark, d)
    compact, _, _ = W.evaluate(oof, VARS)
    inside = [F.col(f"auc_{a}").between(0, 1) & F.col(f"tss_{a}").between(-1, 1) for a in [*WHOLE, "ensemble"]]
    checked = compact.withColumn("metrics_in_range", F.coalesce(reduce(Column.__and__, inside), F.lit(False)))
    complete = reduce(Column.__and__, [F.col(a).isNotNull() for a in WHOLE])
    tested = oof.filter("split = 'test'").filter(complete).groupBy("species").agg(F.count(F.lit(1)).alias("n_tested"))
    run = W.run_table(checked, trained.chosen, trained.status, training).join(tested, "species", "left")
    return run.select("species", "n_pres", "n_bg", F.col("n_pred").cast("int").alias("n_pred"), "n_folds", F.col("n_fits").cast("int").alias("n_fits"), F.col("n_failed").cast("int").alias("n_failed"), "status", "metrics_in_range", "n_tested")


@query(
    "ml_predict_grid",
    with_views(
        [V.ENV, ENV_OK, V.CELLS, V.BANDS_WIDE],
        f"""SELECT species, n AS n_cells, n AS n_in_range FROM (SELECT DISTINCT species FROM env_ok),
        (SELECT count(*) AS n FROM cells c LEFT JOIN bands_wide b ON b.row = c.row AND b.col = c.col WHERE {COMPLETE})""",
    ),
)
def ml_predict_grid(spark, d):
    """Suitability of the whole grid for every species from four algorithms with their cross-validated weights."""
    layers, _, trained, oof = whole_run(spark, d)
    _, _, folds = W.per_fold_scores(oof, WHOLE)
    maps = W.predict_species(layers, trained, E.tss_weights(stored(folds)))
    return maps.groupBy("species").agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("suitability").between(0, 1)).alias("n_in_range"))


@query("ml_predict_one_species")
def ml_predict_one_species(spark, d):
    """One species by two fitted pipelines with given weights, on the whole grid."""
    models, weights = trained(spark, d)
    suit = W.predict_grid(models, V.feature_cells(spark, d), weights, "Species e")
    return rasters.full_grid(V.cells(spark, d), suit.select("row", "col", "suitability"))


@query("ml_project_present")
def ml_project_present(spark, d):
    """Stored models applied to the cells inside the prediction box."""
    models, weights = trained(spark, d)
    path = sinks.scratch_folder(spark)
    MD.save(models, weights.drop("species"), path)
    loaded, meta = MD.load(spark, path)
    cells = V.feature_cells(spark, d).filter(in_bbox(F.col("lon"), F.col("lat"), S.PREDICTION_BBOX))
    return W.predict_grid(loaded, cells, meta.select(F.lit("Species e").alias("species"), "algo", "weight"), "Species e")


@query(
    "snk_artifact",
    """SELECT part, n_rows, n_rows AS n_same FROM (
        SELECT 'scores' AS part, count(*) AS n_rows FROM embeddings UNION ALL SELECT 'environment', count(*) FROM embeddings
        UNION ALL SELECT 'weights', 2 UNION ALL SELECT 'thresholds', 2
        UNION ALL SELECT 'fold_scores', 2 * least(5, count(DISTINCT (embedding[7], embedding[8]))) FROM embeddings WHERE label < 3)""",
)
def snk_artifact(spark, d):
    """A stored bundle read again: per part, its rows and how many equal those that were written."""
    algorithms = ["glm", "maxent"]
    data = stored(training(spark, d))
    models = MD.fit_all(data, P, algorithms)
    _, _, folds = W.per_fold_scores(MD.cross_validate(data, P, algorithms), algorithms)
    folds = stored(folds)
    scored = stored(MD.score_all(models, data, algorithms).select("row_id", "presence", *algorithms))
    tables = {
        "weights": stored(E.tss_weights(folds)), "thresholds": stored(BU.score_thresholds(scored, algorithms)),
        "fold_scores": folds, "environment": stored(BU.training_environment(data, P)),
    }
    path = sinks.scratch_folder(spark)
    BU.write(path, models, tables)
    again = BU.read(spark, path)
    # whole rows as keys with their number, so repeated rows count as often as they are there
    counted = lambda df, n: df.groupBy(F.xxhash64(*df.columns).alias("h"), F.to_json(F.struct(*df.columns)).alias("r")).agg(F.count(F.lit(1)).alias(n))
    pairs = {**{k: (tables[k], again.tables[k]) for k in tables}, "scores": (scored.select("row_id", *algorithms), MD.score_all(again.models, data, algorithms).select("row_id", *algorithms))}
    parts = [
        counted(x, "n").join(counted(y, "m"), ["h", "r"], "full")
        .agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.least(F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0)))), F.lit(0)).alias("n_same"))
        .select(F.lit(name).alias("part"), "n_rows", "n_same")
        for name, (x, y) in pairs.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query("ml_project_scenarios")
def ml_project_scenarios(spark, d):
    """Present and future areas under every climate scenario and their mean."""
    models, weights = trained(spark, d)
    cells = V.feature_cells(spark, d)
    names = ["presente", *[f"{g}_{s}" for g in S.GCMS for s in S.SSPS]]
    shift = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(i * 0.02).alias("by")) for i, n in enumerate(names)]))
    moved = cells.withColumn("s", shift).withColumns({p: F.col(p) + F.col("s.by") for p in P}).withColumn("scenario", F.col("s.scenario")).drop("s")
    maps = W.predict_scenarios(models, moved, weights, "Species e")
    present = maps.filter("scenario = 'presente'")
    keys = ["species", "row", "col", "lat"]
    mean = SC.over_scenarios(maps.filter("scenario <> 'presente'"), keys)
    train = V.features(spark, d)
    limits = M.thresholds(E.with_ensemble(MD.score_all(models, train), weights).withColumn("score", F.col("ensemble")), ["species"])
    named = SC.named_limits(limits, ["species"])
    first = SC.area_table(maps, named, ["species"])
    ahead = mean.select(*keys, F.lit("futuro_mean").alias("scenario"), F.col("future_mean").alias("suitability"))
    second = SC.area_table(present.select(*keys, "scenario", "suitability").unionByName(ahead), named, ["species"])
    return SC.merge_area_tables(first, second)


@query("ml_scenario_mess")
def ml_scenario_mess(spark, d):
    """Share of the first scenario outside the training environment."""
    first = V.feature_cells(spark, d).withColumns({p: F.col(p) + 0.05 for p in P}).na.drop(subset=P)
    values = ME.mess(V.features(spark, d), first, P, [], ["row", "col"])
    return values.agg(F.round(ME.extrapolated(), 4).alias("pct_extrapolated"), F.count("mess").alias("n"))


@query(
    "ml_method_by_n",
    with_views(
        [V.OCC],
        """SELECT species, replace(lower(species), ' ', '_') AS slug, n_pres, CASE WHEN n_pres >= 600 THEN 'ensemble' WHEN n_pres >= 60 THEN 'maxent_low_n' ELSE 'range' END AS method,
        CASE WHEN n_pres >= 600 THEN 'ALTA' WHEN n_pres >= 60 THEN 'BAJA' ELSE 'RANGO' END AS confidence, replace(lower(species), ' ', '_') || '_idoneidad_sa' AS output
        FROM (SELECT species, count(*) AS n_pres FROM occ GROUP BY species)""",
    ),
)
def ml_method_by_n(spark, d):
    return W.confidence_table(V.occ(spark, d), 600, 60)


@query("ml_small_species_maps", SQL["ml_eoo"])
def ml_small_species_maps(spark, d):
    """Range maps of the species the method table leaves without a model."""
    o = V.occ(spark, d)
    n = V.table(spark, d, "events").count()
    table = W.confidence_table(o, -(-n * 2 // 33), -(-n * 2 // 33))
    return rounded(W.small_species_maps(o, V.cells(spark, d).filter("elevation IS NOT NULL"), V.grid(spark, d), table))


@query("ml_permutation_importance")
def ml_permutation_importance(spark, d):
    t = V.features(spark, d)
    model = MD.fit(t, P, "rf", LIGHT)
    return in_unit(IM.permutation_importance(model, t, ["row_id"], repeats=3), "importance")


@query("ml_ensemble_importance")
def ml_ensemble_importance(spark, d):
    models, _ = trained(spark, d)
    out = IM.ensemble_importance(models, {"glm": 0.4, "maxent": 0.6}, V.features(spark, d), ["row_id"], repeats=2)
    return in_unit(out, "importance", "pct")


IMP = "imp AS (SELECT species, algo AS variable, round(avg(score), 6) AS value FROM scored_long GROUP BY 1, 2)"


def importances(spark, d):
    return V.scored_long(spark, d).groupBy("species", F.col("algo").alias("variable")).agg(F.round(F.avg("score"), 6).alias("value"))


@query(
    "w_topk_importance",
    with_views([V.SCORED_LONG, IMP, "ranked AS (SELECT *, variable || ' (' || printf('%.3f', value) || ')' AS label, row_number() OVER (PARTITION BY species ORDER BY value DESC, variable) AS rn FROM imp)"],
               "SELECT species, max(CASE WHEN rn = 1 THEN label END) AS top1, max(CASE WHEN rn = 2 THEN label END) AS top2, max(CASE WHEN rn = 3 THEN label END) AS top3 FROM ranked GROUP BY species"),
)
def w_topk_importance(spark, d):
    return IM.top(importances(spark, d), 3)


@query("w_rank_global", with_views([V.SCORED_LONG, IMP], "SELECT variable, round(avg(value), 4) AS mean FROM imp GROUP BY variable"))
def w_rank_global(spark, d):
    return IM.global_ranking(importances(spark, d)).withColumn("mean", F.round("mean", 4))


@query("ag_importance_summary", with_views([V.SCORED_LONG, IMP], "SELECT variable, count(*) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(max(value), 4) AS max FROM imp GROUP BY variable"))
def ag_importance_summary(spark, d):
    return IM.summary(importances(spark, d)).withColumns({c: F.round(c, 4) for c in ("mean", "median", "max")})


@query(
    "ag_pivot_importance",
    with_views([V.SCORED_LONG, IMP], "SELECT species, " + ", ".join(f"max(CASE WHEN variable = '{a}' THEN round(value, 4) END) AS {a}" for a in S.ALGORITHMS) + " FROM imp GROUP BY species"),
)
def ag_pivot_importance(spark, d):
    return IM.matrix(importances(spark, d), S.ALGORITHMS)


def auc_expr(keys):
    return f"""SELECT {keys}, (sum(CASE WHEN presence = 1 THEN r ELSE 0 END) - max(p) * (max(p) + 1) / 2.0::DOUBLE) / (max(p) * max(n)) AS auc FROM (
      SELECT {keys}, presence, rank() OVER (PARTITION BY {keys} ORDER BY score)::DOUBLE + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0::DOUBLE AS r,
      (sum(presence) OVER (PARTITION BY {keys}))::DOUBLE AS p, (sum(1 - presence) OVER (PARTITION BY {keys}))::DOUBLE AS n FROM es) GROUP BY {keys}"""


SUMMARY_VIEWS = [
    V.SCORED_LONG,
    TRAIN_BEST,
    WEIGHTS,
    ENS,
    "es AS (SELECT *, 'e' AS algo, round(ensemble, 9) AS score FROM ens WHERE ensemble IS NOT NULL)",
    """e_counts AS (SELECT species, score, sum(presence)::BIGINT AS pos, sum(1 - presence)::BIGINT AS neg FROM es GROUP BY 1, 2),
e_roc AS (SELECT *, tot_pos - cum_pos + pos AS tp, tot_neg - cum_neg + neg AS fp FROM (SELECT *, (sum(pos) OVER run)::BIGINT AS cum_pos,
  (sum(neg) OVER run)::BIGINT AS cum_neg, (sum(pos) OVER grp)::BIGINT AS tot_pos, (sum(neg) OVER grp)::BIGINT AS tot_neg FROM e_counts
  WINDOW run AS (PARTITION BY species ORDER BY score), grp AS (PARTITION BY species))),
e_best AS (SELECT species, score AS thr FROM (SELECT *, row_number() OVER (PARTITION BY species ORDER BY tp * tot_neg - fp * tot_pos DESC, score) AS rn FROM e_roc) WHERE rn = 1),
e_p10 AS (SELECT species, quantile_cont(score, 0.1) AS p10 FROM es WHERE presence = 1 GROUP BY species),
e_stat AS (SELECT es.species, max(thr) AS thr, max(p10) AS p10, count(*) FILTER (presence = 1 AND score >= thr)::DOUBLE AS tp,
  count(*) FILTER (presence = 0 AND score >= thr)::DOUBLE AS fp, count(*) FILTER (presence = 1 AND score < thr)::DOUBLE AS fn,
  count(*) FILTER (presence = 0 AND score < thr)::DOUBLE AS tn, count(*) FILTER (presence = 1 AND score < p10)::DOUBLE AS below,
  avg((score - presence) * (score - presence)) AS brier FROM es JOIN e_best USING (species) JOIN e_p10 USING (species) GROUP BY es.species)""",
    f"e_auc AS ({auc_expr('species')})",
    f"e_fold AS ({auc_expr('species, cv_fold')})",
    BOYCE_UNIT.replace("scored_long", "es"),
    RANKED,
    "e_boyce AS (SELECT species, CASE WHEN count(*) >= 5 AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) END AS boyce FROM ranked GROUP BY species)",
    "e_ap AS (SELECT species, sum(pos / tot_pos::DOUBLE * (tp / (tp + fp)::DOUBLE)) AS ap FROM e_roc GROUP BY species)",
]


@query(
    "m_species_summary",
    with_views(
        SUMMARY_VIEWS,
        """SELECT s.species, (SELECT count(*) FROM scored x WHERE x.species = s.species AND presence = 1) AS n_presence, round(thr, 6) AS "maxTSS", round(p10, 6) AS p10,
        round(auc, 6) AS ens_auc, round(ap, 6) AS ens_auc_pr, round(tp / (tp + fn) + tn / (tn + fp) - 1, 6) AS ens_tss, round(2 * tp / (2 * tp + fp + fn), 6) AS ens_f1,
        round(below / (tp + fn), 6) AS ens_or10, round(brier, 6) AS ens_brier, round(boyce, 6) AS ens_boyce,
        (SELECT count(*) FROM e_fold f WHERE f.species = s.species) AS n_folds, (SELECT round(avg(f.auc), 6) FROM e_fold f WHERE f.species = s.species) AS auc_mean,
        'spatial_cv_oof' AS metrics_source FROM e_stat s JOIN e_auc USING (species) JOIN e_ap USING (species) JOIN e_boyce USING (species)""",
    ),
)
def m_species_summary(spark, d):
    e = E.with_ensemble(V.scored(spark, d), E.tss_weights(fold_table(spark, d)))
    # equal scores must stay equal whatever the order of the weighted sum
    t = W.species_summary(e.withColumn("ensemble", F.round("ensemble", 9)), spread=False)
    t = t.select("species", "n_presence", "maxTSS", "p10", "ens_auc", "ens_auc_pr", "ens_tss", "ens_f1", "ens_or10", "ens_brier", "ens_boyce", "n_folds", "auc_mean", "metrics_source")
    return rounded(t)
