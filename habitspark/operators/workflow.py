"""Whole-species runs: cross-validated evaluation, prediction, projection, summaries."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from habitspark import settings as S
from habitspark.functions import text
from habitspark.functions.geo import Grid
from habitspark.operators import boosting, linear
from habitspark.operators import ensemble as E
from habitspark.operators import mess as ME
from habitspark.operators import metrics as M
from habitspark.operators import models as MD
from habitspark.operators import spatial
from habitspark.plans.scale import attach, measured, scratch_folder, stored

log = logging.getLogger(__name__)

SPECIES = ["species"]
ALL = [*S.ALGORITHMS, "ensemble"]


def per_fold_scores(oof: DataFrame, algorithms: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(long scores, thresholds from the training rows, AUC and TSS on the held-out rows)."""
    ids = ["species", "held_out", "split", "presence"]
    long = oof.select(*ids, *algorithms).unpivot(ids, list(algorithms), "algo", "score").filter("score IS NOT NULL")
    keys = ["species", "algo", "held_out"]
    limits = M.max_tss_roc(long.filter("split = 'train'"), keys)
    return long, limits, M.fold_metrics(long.filter("split = 'test'"), ["species", "algo"], "held_out", limits)


def cross_validate_species(
    training: DataFrame, chosen: DataFrame, algorithms: Sequence[str] = tuple(S.ALGORITHMS), overrides=None, threads: int = 4, status: list | None = None
) -> DataFrame:
    """Cross-validated scores of every species with its own predictors, in one table.

    ``training`` and ``chosen`` come from ``training.build``. The driver holds the species
    names and their predictor names; a species without a usable fold is left out. ``status``
    gets a row per species, fold and algorithm for ``status_table``.
    """
    spark = training.sparkSession
    path = scratch_folder(spark)
    names = F.transform(F.array_sort(F.collect_list(F.struct("position", "predictor"))), lambda p: p["predictor"])
    for row in chosen.groupBy("species").agg(names.alias("predictors")).orderBy("species").collect():
        own = training.filter(F.col("species") == row["species"])
        rows: list = []
        if MD.usable_folds(own):
            MD.cross_validate(own, row["predictors"], algorithms, overrides, threads, path, rows)
        else:
            log.warning("%s left out: no fold holds presences and background", row["species"])
            rows.append((None, None, "failed", "no fold holds presences and background"))
        if status is not None:
            status += [(row["species"], *r) for r in rows]
    return spark.read.parquet(path)


@dataclass
class Trained:
    """Models of all species: linear and boosted ones as tables, forests as pipelines by species and left-out fold (None: none)."""

    names: list[str]
    chosen: DataFrame
    linear: DataFrame
    boosted: DataFrame
    forests: dict[tuple[str, int | None], MD.Model]
    status: DataFrame


def train_species(
    training: DataFrame, chosen: DataFrame, names: Sequence[str], overrides=None, boosting_settings: Mapping | None = None, forests: bool = True,
    folds: bool = True, threads: int = 8,
) -> Trained:
    """Fit all algorithms of all species, on all rows and without each usable fold.

    ``training`` and ``chosen`` come from ``training.build``. Linear models and boosted trees of all species are a few
    plans in all. Forests are Spark ML fits on distributed rows, ``threads`` of them in flight; so are boosted trees of species too
    large for one task. The driver holds names of species and their predictors. ``status`` has a row per species,
    left-out fold and algorithm: ok, or what went wrong.
    """
    names = list(names)
    spark = training.sparkSession
    # clustered by species, so that a fit reads the row groups of its own
    data = stored(training.sortWithinPartitions("species")).persist(StorageLevel.MEMORY_AND_DISK)
    fitted = linear.fit_linear(data, chosen, names, overrides=overrides, folds=folds)
    boosted = boosting.fit_boosted(data, chosen, names, boosting_settings, folds)
    states = [fitted.select("species", "held_out", "algo", "status"), boosted.select("species", "held_out", F.lit("gbm").alias("algo"), "status")]
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "predictor"))), lambda p: p["predictor"])
    own = {r["species"]: r["predictors"] for r in chosen.groupBy("species").agg(ordered.alias("predictors")).collect()}
    jobs = [(r["species"], r["held_out"], "gbm") for r in boosted.filter("status = 'too large'").select("species", "held_out").collect()]
    profiles = {}
    if forests:
        for r in boosted.filter("status = 'ok'").select("species", "held_out", "n_pres", "n_bg").collect():
            jobs.append((r["species"], r["held_out"], "rf"))
            profiles[jobs[-1]] = MD.Profile(r["n_pres"], r["n_bg"], {}, {}, {}, {})  # a forest needs the counts only
        jobs += [(species, held_out, "rf") for species, held_out, algo in jobs if algo == "gbm"]
    tried: list = []

    def one(job: tuple[str, int | None, str]) -> MD.Model | None:
        species, held_out, algo = job
        rows = data.filter(F.col("species") == species)
        rows = rows if held_out is None else rows.filter(F.col("cv_fold") != held_out)
        return MD.attempt(lambda: MD.fit(rows, own[species], algo, overrides, profiles.get(job)), tried, species, held_out, algo)

    with ThreadPoolExecutor(threads) as pool:
        found = {job: m for job, m in zip(jobs, pool.map(one, jobs)) if m is not None}
    data.unpersist()
    if tried:
        states.append(spark.createDataFrame([(s, k, a, text if state == "failed" else state) for s, k, a, state, text in tried], "species string, held_out int, algo string, status string"))
    table = states[0]
    for more in states[1:]:
        table = table.unionByName(more)
    return Trained(names, chosen, fitted, boosted, found, table.filter("status <> 'too large'"))


def _scored_by_trees(rows: DataFrame, trained: Trained, keys: Sequence[str], threads: int = 8) -> DataFrame:
    """Add ``gbm`` and ``rf``; rows of species without such a model get null.

    A forest scores the rows of its species and fold from a written table and writes them to a folder of its own, several
    at a time, so the plan does not grow with the number of models.
    """
    models = trained.boosted if "held_out" in keys else trained.boosted.filter("held_out IS NULL")
    out = boosting.score_boosted(rows, models, trained.names, keys).withColumn("rf", F.lit(None).cast("double"))
    for algo in ("gbm", "rf"):
        wanted = {k[:2]: m for k, m in trained.forests.items() if k[2] == algo and ("held_out" in keys) == (k[1] is not None)}
        if wanted:
            out = _appended(stored(out), algo, wanted, keys, threads)
    return out


def _appended(table: DataFrame, algo: str, wanted: Mapping[tuple[str, int | None], MD.Model], keys: Sequence[str], threads: int) -> DataFrame:
    spark, path = table.sparkSession, scratch_folder(table.sparkSession)

    def one(job: tuple[int, tuple[tuple[str, int | None], MD.Model]]) -> None:
        number, ((species, held_out), model) = job
        part = table.filter(F.col("species") == species)
        part = part if held_out is None else part.filter(F.col("held_out") == held_out)
        complete = reduce(Column.__and__, [F.col(p).isNotNull() for p in model.predictors])
        scored = model.score(part.filter(complete).drop(algo)).select(*table.columns)
        scored.unionByName(part.filter(~complete)).write.parquet(f"{path}/part={number}")

    with ThreadPoolExecutor(threads) as pool:
        list(pool.map(one, enumerate(wanted.items())))
    known = spark.createDataFrame([(s, k) for s, k in wanted], "species string, held_out int").select(*keys)
    rest = table.join(known, list(keys), "left_anti").select(*table.columns)
    return rest.unionByName(spark.read.schema(table.schema).parquet(*[f"{path}/part={n}" for n in range(len(wanted))]))


def cross_scores(training: DataFrame, trained: Trained) -> DataFrame:
    """Scores of every row by the models of each left-out fold, in one written table for ``evaluate``."""
    rows = linear.cross_scores(training, trained.linear, trained.names)
    scored = _scored_by_trees(rows, trained, ["species", "held_out"])
    order = [c for c in rows.columns if c not in S.ALGORITHMS]
    return stored(scored.select(*order, *S.ALGORITHMS))


def predict_species(cells: DataFrame, trained: Trained, weights: DataFrame) -> DataFrame:
    """Ensemble suitability of every cell for every species, from its own predictors, with cross-validated weights.

    ``cells`` has row, col and the layers. A cell lacking a predictor that a species uses has no row for it.
    """
    lists = trained.chosen.groupBy("species").agg(F.collect_set("predictor").alias("_own"))
    lists, small = measured(lists)
    pairs = cells.join(F.broadcast(lists) if small else lists)  # every cell for every species is the result asked for
    complete = F.lit(True)
    for n in trained.names:
        complete = complete & (F.col(n).isNotNull() | ~F.array_contains("_own", n))
    rows = linear.score_models(pairs.filter(complete).drop("_own"), trained.linear.filter("held_out IS NULL"), trained.names)
    scored = E.with_ensemble(_scored_by_trees(rows, trained, SPECIES), weights)
    return scored.filter("ensemble IS NOT NULL").select("species", "row", "col", F.col("ensemble").cast("float").alias("suitability"))


def run_table(evaluated: DataFrame, chosen: DataFrame, status: DataFrame, training: DataFrame) -> DataFrame:
    """One row per species that was asked for: counts, predictors, metrics if any, and whether all of its fits went well."""
    y = F.col("presence")
    counts = training.groupBy("species").agg(F.count_if(y == 1).alias("n_pres"), F.count_if(y == 0).alias("n_bg"))
    n_pred = chosen.groupBy("species").agg(F.count(F.lit(1)).alias("n_pred"))
    state = status.groupBy("species").agg(F.count_if(F.col("status") != "ok").alias("n_failed"), F.count(F.lit(1)).alias("n_fits"))
    out = counts.join(n_pred, "species", "left").join(state, "species", "left").join(evaluated.drop("n_pres", "n_bg", "n_pred"), "species", "left")
    return out.withColumn("status", F.when(F.col("n_fits").isNull(), "no model").when(F.col("n_failed") > 0, "incomplete").otherwise("ok"))


def status_table(spark: SparkSession, status: Sequence[tuple]) -> DataFrame:
    """What was fitted and what was not, one row per species, fold and algorithm."""
    return spark.createDataFrame(list(status), "species string, fold int, algo string, status string, message string")


def evaluate(oof: DataFrame, predictors: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(compact table, full table, weights) of all species from cross-validated scores.

    ``oof`` has species, held_out, split, presence, predictors and a score per algorithm.
    Thresholds always come from the training rows of a fold.
    """
    _, limits, folds = per_fold_scores(oof, S.ALGORITHMS)
    limits, folds = stored(limits), stored(folds)  # a row per species, algorithm and fold
    weights = E.tss_weights(folds)
    scored = stored(E.with_ensemble(oof, weights))
    _, _, ens_folds = per_fold_scores(scored, ["ensemble"])
    both = M.fold_summary(folds.unionByName(ens_folds), ["species", "algo"])
    wide = both.groupBy("species").pivot("algo", ALL).agg(
        F.first("auc_mean").alias("auc"), F.first("tss_mean").alias("tss"), F.first("auc_sd").alias("auc_std"), F.first("tss_sd").alias("tss_std")
    )
    names = [F.col(f"{a}_{m}").alias(f"{m}_{a}") for a in ALL for m in ("auc", "tss")]
    names += [F.col(f"ensemble_{m}_std").alias(f"{m}_ensemble_std") for m in ("auc", "tss")]
    test = scored.filter("split = 'test'").withColumnRenamed("ensemble", "score")
    whole = oof.filter(F.col("split") == "test")
    counts = whole.groupBy("species").agg(
        F.expr("count_if(presence = 1) AS n_pres"), F.expr("count_if(presence = 0) AS n_bg"), F.expr("count(DISTINCT held_out) AS n_folds")
    )
    compact = counts.join(wide.select("species", *names), "species", "left")
    compact = stored(compact).join(M.boyce_range(test, SPECIES).withColumnRenamed("boyce", "boyce_ensemble"), "species", "left")
    best = M.max_tss_roc(test, SPECIES)
    full = compact.join(M.discrimination(test, SPECIES, best).select("species", F.col("auc_pr").alias("ens_auc_pr"), F.col("f1").alias("ens_f1")), "species", "left")
    full = full.join(M.brier(test, SPECIES).withColumnRenamed("brier", "ens_brier"), "species", "left")
    full = full.join(M.omission_p10(test, SPECIES).withColumnsRenamed({"p10": "ens_p10", "or10": "ens_or10"}), "species", "left")
    line = M.calibration_line(test, SPECIES)
    full = full.join(line.withColumnsRenamed({"calib_slope": "ens_calib_slope", "calib_intercept": "ens_calib_intercept"}), "species", "left")
    outside = ME.outside_range(whole.filter("presence = 1"), whole, predictors, SPECIES)
    full = full.join(outside.withColumnRenamed("pct_outside", "mess_pct_extrapolation"), "species", "left")
    full = full.join(fold_uncertainty(scored.filter("split = 'test'"), limits), "species", "left")
    return compact, full, weights


def fold_uncertainty(test: DataFrame, limits: DataFrame) -> DataFrame:
    """Spread and agreement of the algorithms per fold, then averaged over folds."""
    t = limits.groupBy("species", "held_out").pivot("algo", S.ALGORITHMS).agg(F.first("threshold"))
    t = t.select("species", "held_out", *[F.col(a).alias(f"t_{a}") for a in S.ALGORITHMS])
    keys = ["species", "held_out"]
    calls = E.agreement(test, t, keys)
    spread = test.groupBy(*keys).agg(F.avg(E.row_spread()).alias("sd"))
    return calls.join(spread, keys).groupBy("species").agg(
        F.avg("sd").alias("algo_sd_mean"),
        F.avg("agreement_mean").alias("binary_agreement_mean"),
        F.avg("unanimous_pct").alias("binary_agreement_unanimous_pct"),
    )


_kept = stored


def species_summary(scores: DataFrame, stored: DataFrame | None = None, has_folds: bool = True, spread: bool = True) -> DataFrame:
    """Validation row per species from out-of-fold scores (five algorithms and ensemble).

    A stored maxTSS or p10 threshold (``stored``: species, maxTSS, p10) goes before one
    derived from the scores. ``spread`` adds how far the algorithms differ.
    """
    folds = [c for c in ("cv_fold",) if has_folds]
    scores = _kept(scores.select("species", *folds, "presence", *S.ALGORITHMS, "ensemble"))
    ens = scores.withColumn("score", F.col("ensemble")).filter("score IS NOT NULL")
    counts = scores.groupBy("species").agg(F.expr("count_if(presence = 1) AS n_presence"), F.expr("count_if(presence = 0) AS n_background"))
    roc = _kept(M.roc_table(ens, SPECIES))
    own = M.roc_thresholds(roc, SPECIES)
    if stored is not None:
        kept = stored.select("species", F.col("maxTSS").alias("_max"), F.col("p10").alias("_p10"))
        own = own.join(kept, "species", "left").select("species", F.coalesce("_max", "maxTSS").alias("maxTSS"), F.coalesce("_p10", "p10").alias("p10"))
    limit = own.select("species", F.col("maxTSS").alias("threshold"))
    d = M.discrimination(ens, SPECIES, limit, roc=roc).select("species", *[F.col(c).alias(f"ens_{c}") for c in ("auc", "auc_pr", "tss", "f1")])
    or10 = M.confusion(ens, own.select("species", F.col("p10").alias("threshold")), SPECIES, counts=roc).select("species", F.col("omission").alias("ens_or10"))
    out = counts.join(own, "species").join(d, "species", "left").join(or10, "species", "left")
    tables = [
        M.brier(ens, SPECIES, clip=False).withColumnRenamed("brier", "ens_brier"),
        M.calibration_line(ens, SPECIES),
        M.boyce_unit(ens, SPECIES).withColumnRenamed("boyce", "ens_boyce"),
    ]
    if spread:
        tables += [E.algorithm_spread(scores, SPECIES), E.agreement(scores, limit, SPECIES)]
    for t in tables:
        out = out.join(t, "species", "left")
    if has_folds:
        folds = M.fold_metrics(ens, SPECIES, "cv_fold", limit)
        out = out.join(M.fold_summary(folds, SPECIES), "species", "left")
    return out.withColumn("metrics_source", F.lit("spatial_cv_oof" if has_folds else "training_set_WARNING"))


def predict_grid(models: Mapping[str, MD.Model], cells: DataFrame, weights: DataFrame, species: str) -> DataFrame:
    """Ensemble suitability of every cell that has all predictors."""
    predictors = next(iter(models.values())).predictors
    valid = cells.na.drop(subset=predictors).withColumn("species", F.lit(species))
    scored = E.with_ensemble(MD.score_all(models, valid), weights)
    return scored.select("species", "row", "col", F.col("ensemble").cast("float").alias("suitability"))


def predict_scenarios(models: Mapping[str, MD.Model], cells: DataFrame, weights: DataFrame, species: str) -> DataFrame:
    """Like ``predict_grid`` with the scenario as a column, one pass for all of them."""
    predictors = next(iter(models.values())).predictors
    valid = cells.na.drop(subset=predictors).withColumn("species", F.lit(species))
    scored = E.with_ensemble(MD.score_all(models, valid), weights)
    return scored.select("species", "scenario", "row", "col", "lat", F.col("ensemble").alias("suitability"))



def confidence_table(presences: DataFrame, min_records: int = S.MIN_RECORDS, low_n: int = S.LOW_N_MIN_RECORDS) -> DataFrame:
    """Mapping method and confidence label per species by its number of records."""
    n = presences.groupBy("species").agg(F.count(F.lit(1)).alias("n_pres"))
    method = F.when(F.col("n_pres") >= min_records, "ensemble").when(F.col("n_pres") >= low_n, "maxent_low_n").otherwise("range")
    label = F.when(F.col("n_pres") >= min_records, "ALTA").when(F.col("n_pres") >= low_n, "BAJA").otherwise("RANGO")
    slug = text.slug(F.col("species"))
    return n.select("species", slug.alias("slug"), "n_pres", method.alias("method"), label.alias("confidence"), F.concat(slug, F.lit("_idoneidad_sa")).alias("output"))


def small_species_maps(presences: DataFrame, cells: DataFrame, grid: Grid, table: DataFrame) -> DataFrame:
    """Range maps for every species the table assigns to that method."""
    chosen = attach(presences, table.filter("method = 'range'").select("species"), SPECIES)
    return spatial.range_map(chosen, cells, grid)
