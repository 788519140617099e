"""Presence/background models on Spark ML: fit, score, cross-validate, store.

A model is a pipeline of a SQL step that prepares the predictors, an assembler and an
estimator, so it trains on distributed rows and can be saved and loaded as a whole. The
driver keeps only per-predictor statistics, and the trees of small forests; larger ones are tables (``forest``).
"""

from __future__ import annotations

import logging
import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import combinations
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.errors import IllegalArgumentException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitspark import settings as S
from habitspark.operators.forest import Forest, fit_forest, score_forest
from habitspark.plans.scale import scratch_folder, stored

log = logging.getLogger(__name__)

# Settings of the published models and their tuned counterparts.
DEFAULTS: dict[str, dict[str, Any]] = {
    "glm": {"C": 1.0, "maxIter": 200},
    "gam": {"n_splines": 20, "lam": 0.6, "maxIter": 100},
    "rf": {"numTrees": 300, "maxDepth": 30, "minInstancesPerNode": 1, "featureSubsetStrategy": "sqrt"},
    "gbm": {"maxIter": 400, "stepSize": 0.1, "maxDepth": 5, "minInstancesPerNode": 20, "subsamplingRate": 1.0},
    "maxent": {"features": ("linear", "quadratic", "product"), "beta": 1.5, "background_weight": 100.0, "clamp": True, "maxIter": 200, "hinges": 10},
}
TUNED: dict[str, dict[str, Any]] = {
    "glm": {"C": 0.5},
    "gam": {"n_splines": 25, "lam": 10.0},
    "rf": {"numTrees": 300, "maxDepth": 30, "minInstancesPerNode": 8, "featureSubsetStrategy": "log2"},
    "gbm": {"maxIter": 800, "stepSize": 0.05, "minInstancesPerNode": 20, "subsamplingRate": 0.7},
    "maxent": {"beta": 1.593},
}
LOW_N_MAXENT: dict[str, Any] = {"features": ("linear", "product"), "beta": 3.0, "clamp": True}
# nodes of a forest that the driver may hold
DRIVER_NODES = 100_000
# Regularisation of linear, quadratic and product features by sample size.
REGULARISATION = [(0, 1.0), (10, 1.0), (30, 0.2), (100, 0.05)]


def parameters(algo: str, overrides: Mapping[str, Mapping[str, Any]] | None = None) -> dict[str, Any]:
    """Defaults overlaid by the given settings of that algorithm."""
    if algo not in DEFAULTS:
        raise ValueError(f"unknown algorithm: {algo}")
    return {**DEFAULTS[algo], **dict((overrides or {}).get(algo, {}))}


def read_overlay(settings: DataFrame) -> dict[str, dict[str, Any]]:
    """Settings from a table of ``algo``, ``parameter`` and ``value`` (text), typed like the defaults.

    What no algorithm takes is refused by name, and so is a setting with two values; the same row twice counts once.
    """
    out: dict[str, dict[str, Any]] = {}
    each = settings.groupBy("algo", "parameter").agg(F.min("value").alias("value"), F.max("value").alias("other"))
    # one row more than there are settings: a longer table holds an unknown one among these
    for row in each.limit(sum(map(len, DEFAULTS.values())) + 1).collect():
        known = DEFAULTS.get(row["algo"])
        if known is None:
            raise ValueError(f"unknown algorithm: {row['algo']}")
        if row["parameter"] not in known:
            raise ValueError(f"{row['algo']} has no setting {row['parameter']}; it takes {sorted(known)}")
        given = known[row["parameter"]]
        text = row["value"]
        if text is None or text != row["other"]:
            raise ValueError(f"{row['algo']} {row['parameter']} needs one value, got {text} and {row['other']}")
        if isinstance(given, bool):
            value: Any = text.lower() == "true"
        elif isinstance(given, tuple):
            value = tuple(v.strip() for v in text.split(",") if v.strip())
        elif isinstance(given, int) and text.lstrip("-").isdigit():
            value = int(text)
        else:
            value = text if isinstance(given, str) else float(text)
        out.setdefault(row["algo"], {})[row["parameter"]] = value
    return out


def parameter_table(spark: SparkSession, overrides: Mapping[str, Mapping[str, Any]] | None = None) -> DataFrame:
    rows = [(a, k, str(v)) for a in DEFAULTS for k, v in parameters(a, overrides).items()]
    return spark.createDataFrame(rows, "algo string, parameter string, value string")


@dataclass(frozen=True)
class Profile:
    """Counts and predictor statistics of a training set."""

    n_presence: int
    n_background: int
    mean: dict[str, float]
    sd: dict[str, float]
    low: dict[str, float]
    high: dict[str, float]

    @classmethod
    def of(cls, train: DataFrame, predictors: Sequence[str]) -> "Profile":
        aggs = [F.expr("count_if(presence = 1) AS np"), F.expr("count_if(presence = 0) AS nb")]
        for p in predictors:
            aggs += [F.expr(f"{fn}(`{p}`) AS `{a}_{p}`") for a, fn in (("m", "avg"), ("s", "stddev_pop"), ("l", "min"), ("h", "max"))]
        r = train.agg(*aggs).first()
        if not r["np"] or not r["nb"]:
            raise ValueError("training needs presences and background")
        pick = lambda a: {p: float(r[f"{a}_{p}"]) for p in predictors}
        sd = {p: v or 1.0 for p, v in pick("s").items()}
        return cls(r["np"], r["nb"], pick("m"), sd, pick("l"), pick("h"))


@dataclass
class Model:
    """A fitted algorithm. ``shift`` turns the linear score of MaxEnt into cloglog."""

    algo: str
    predictors: list[str]
    pipeline: PipelineModel | Forest
    shift: float = 0.0

    def score(self, df: DataFrame) -> DataFrame:
        """Add the suitability as a column named after the algorithm."""
        if isinstance(self.pipeline, Forest):
            return score_forest(df, self.pipeline, self.predictors, self.algo)
        out = self.pipeline.transform(df)
        if self.algo == "maxent":
            value = 1.0 - F.exp(-F.exp(vector_to_array("_raw")[1] + F.lit(self.shift)))
        else:
            value = vector_to_array("_prob")[1]
        return out.select(*[c for c in df.columns if c != self.algo], value.alias(self.algo))


def _scaled(p: str, s: Profile) -> str:
    return f"((`{p}` - {s.mean[p]!r}D) / {s.sd[p]!r}D)"


def _unit(p: str, s: Profile, clamp: bool) -> str:
    span = (s.high[p] - s.low[p]) or 1.0
    v = f"least(greatest(`{p}`, {s.low[p]!r}D), {s.high[p]!r}D)" if clamp else f"`{p}`"
    return f"(({v} - {s.low[p]!r}D) / {span!r}D)"


def _spline(p: str, s: Profile, n: int) -> list[tuple[str, str]]:
    """Cubic B-spline basis on equal knots over the training range: (distance to knot, value of d)."""
    value = "CASE WHEN {d} < 1 THEN (4 - 6 * {d} * {d} + 3 * {d} * {d} * {d}) / 6 WHEN {d} < 2 THEN (2 - {d}) * (2 - {d}) * (2 - {d}) / 6 ELSE 0D END"
    return [(f"abs({_unit(p, s, True)} * {float(n - 3)}D - {float(k - 1)}D)", value) for k in range(n)]


def _maxent_terms(predictors: Sequence[str], s: Profile, features: Sequence[str], clamp: bool) -> list[str]:
    u = {p: _unit(p, s, clamp) for p in predictors}
    terms = []
    if "linear" in features:
        terms += [u[p] for p in predictors]
    if "quadratic" in features:
        terms += [f"{u[p]} * {u[p]}" for p in predictors]
    if "product" in features:
        terms += [f"{u[a]} * {u[b]}" for a, b in combinations(predictors, 2)]
    return terms


def regularisation(n: int) -> float:
    for (n0, r0), (n1, r1) in zip(REGULARISATION, REGULARISATION[1:]):
        if n <= n1:
            return r0 + (r1 - r0) * (n - n0) / (n1 - n0)
    return REGULARISATION[-1][1]


def _design(algo: str, predictors: Sequence[str], s: Profile, q: Mapping[str, Any]):
    """Input expressions, weight of a background row and estimator of an algorithm."""
    balanced = s.n_presence / s.n_background
    total = 2.0 * s.n_presence
    shared = {"featuresCol": "_features", "labelCol": "presence", "weightCol": "_weight", "predictionCol": "_class"}
    if algo == "glm":
        est = LogisticRegression(**shared, elasticNetParam=1.0, regParam=1.0 / (q["C"] * total), standardization=False, maxIter=q["maxIter"])
        return [_scaled(p, s) for p in predictors], balanced, est
    if algo == "gam":
        est = LogisticRegression(**shared, elasticNetParam=0.0, regParam=q["lam"] / total, standardization=False, maxIter=q["maxIter"])
        return [t for p in predictors for t in _spline(p, s, q["n_splines"])], balanced, est
    if algo == "rf":
        settings = {k: q[k] for k in ("numTrees", "maxDepth", "minInstancesPerNode", "featureSubsetStrategy")}
        # each row keeps its node per tree; otherwise every level sends all trees along and walks them from the root
        est = RandomForestClassifier(**shared, seed=S.SEED, cacheNodeIds=True, **settings)
        return [f"double(`{p}`)" for p in predictors], balanced, est
    if algo == "gbm":
        settings = {k: q[k] for k in ("maxIter", "stepSize", "maxDepth", "minInstancesPerNode", "subsamplingRate")}
        est = GBTClassifier(**shared, seed=S.SEED, **settings)
        return [f"double(`{p}`)" for p in predictors], balanced, est
    if algo == "maxent":
        w = q["background_weight"]
        total = s.n_presence + w * s.n_background
        reg = q["beta"] * regularisation(s.n_presence) * math.sqrt(s.n_presence) / total
        est = LogisticRegression(**shared, elasticNetParam=1.0, regParam=reg, standardization=True, maxIter=q["maxIter"])
        return _maxent_terms(predictors, s, q["features"], q["clamp"]), w, est
    raise ValueError(f"unknown algorithm: {algo}")


def _spread(train: DataFrame, predictors: Sequence[str]) -> DataFrame:
    """Rows in at least as many partitions as there are cores: a small table is one file split, but every row goes down every tree."""
    n = train.sparkSession.sparkContext.defaultParallelism
    if train.rdd.getNumPartitions() >= n:
        return train
    return train.repartition(n).sortWithinPartitions("presence", *predictors)


def _most_nodes(s: Profile, q: Mapping[str, Any]) -> int:
    """Nodes that a forest has at most."""
    return q["numTrees"] * min(2 ** (q["maxDepth"] + 1) - 1, 2 * (s.n_presence + s.n_background))


def fit(train: DataFrame, predictors: Sequence[str], algo: str, overrides=None, profile: Profile | None = None) -> Model:
    """Fit one algorithm; presences weigh 1, background by the scheme of the algorithm."""
    s = profile or Profile.of(train, predictors)
    q = parameters(algo, overrides)
    terms, background_weight, estimator = _design(algo, predictors, s, q)
    if algo == "rf" and _most_nodes(s, q) > DRIVER_NODES:
        return Model(algo, list(predictors), fit_forest(train, predictors, q, background_weight))
    names = [f"_t{i}" for i in range(len(terms))]
    if algo == "gam":
        first = ", ".join(f"{d} AS _d{i}" for i, (d, _) in enumerate(terms))
        columns = ", ".join(f"{v.format(d=f'_d{i}')} AS {n}" for i, (n, (_, v)) in enumerate(zip(names, terms)))
        statement = f"SELECT *, {columns} FROM (SELECT *, {first} FROM __THIS__)"
    else:
        columns = ", ".join(f"{t} AS {n}" for n, t in zip(names, terms))
        statement = f"SELECT *, {columns} FROM __THIS__"
    prepare = SQLTransformer(statement=statement)
    estimator.setProbabilityCol("_prob").setRawPredictionCol("_raw")
    pipeline = Pipeline(stages=[prepare, VectorAssembler(inputCols=names, outputCol="_features"), estimator])
    weighted = train.withColumn("_weight", F.when(F.col("presence") == 1, 1.0).otherwise(float(background_weight)))
    model = Model(algo, list(predictors), pipeline.fit(_spread(weighted, predictors) if algo == "rf" else weighted))
    if algo == "maxent":
        model.shift = _cloglog_shift(model.pipeline.transform(train.filter("presence = 0")))
    return model


def _cloglog_shift(background: DataFrame) -> float:
    """Normaliser plus entropy of the raw distribution over the background."""
    eta = background.select(vector_to_array("_raw")[1].alias("e"))
    top = eta.agg(F.max("e")).first()[0]
    w = F.exp(F.col("e") - F.lit(top))
    r = eta.agg(F.sum(w).alias("z"), F.sum(w * F.col("e")).alias("ze")).first()
    normaliser = -(top + math.log(r["z"]))
    entropy = -(r["ze"] / r["z"] + normaliser)
    return normaliser + entropy


# what a learner raises on data it cannot fit; coding errors and lack of memory are none of these
FIT_ERRORS = (IllegalArgumentException, ArithmeticError, ValueError, Py4JJavaError)


def attempt(task, status: list | None, *label):
    """Result of a fit, or None when the data do not allow it; ``status`` gets (label, ok or failed, message)."""
    try:
        result = task()
    except FIT_ERRORS as err:
        text = str(err)
        if "OutOfMemoryError" in text or "Job aborted" in text:
            raise
        log.warning("%s left out: %s", label, text)
        if status is not None:
            status.append((*label, "failed", text[:500]))
        return None
    if status is not None:
        status.append((*label, "ok", ""))
    return result


def fit_all(train: DataFrame, predictors: Sequence[str], algorithms: Sequence[str] = tuple(S.ALGORITHMS), overrides=None, threads: int = 4, status: list | None = None) -> dict[str, Model]:
    """Fit the algorithms side by side; one that fails is left out. ``status`` gets (algo, ok or failed, message)."""
    profile = Profile.of(train, predictors)

    def one(algo: str) -> Model | None:
        return attempt(lambda: fit(train, predictors, algo, overrides, profile), status, algo)

    with ThreadPoolExecutor(threads) as pool:
        fitted = dict(zip(algorithms, pool.map(one, algorithms)))
    return {a: m for a, m in fitted.items() if m is not None}


def score_all(models: Mapping[str, Model], df: DataFrame, algorithms: Sequence[str] = tuple(S.ALGORITHMS)) -> DataFrame:
    """One column per algorithm, null for those that are not available."""
    out = df
    for a in algorithms:
        out = models[a].score(out) if a in models else out.withColumn(a, F.lit(None).cast("double"))
    return out


def usable_folds(training: DataFrame) -> list[int]:
    """Folds that hold both classes and leave both to train on; one row per fold is read."""
    rows = training.groupBy("cv_fold").agg(F.expr("count_if(presence = 1) AS p"), F.expr("count_if(presence = 0) AS b")).collect()
    p, b = sum(r["p"] for r in rows), sum(r["b"] for r in rows)
    return sorted(r["cv_fold"] for r in rows if 0 < r["p"] < p and 0 < r["b"] < b)


def cross_validate(
    training: DataFrame,
    predictors: Sequence[str],
    algorithms: Sequence[str] = tuple(S.ALGORITHMS),
    overrides=None,
    threads: int = 4,
    path: str | None = None,
    status: list | None = None,
) -> DataFrame:
    """Leave one spatial fold out: scores of all rows by the models of each fold.

    ``held_out`` names the fold a model did not see and ``split`` tells whether the row
    belongs to it. The scores are appended to a table, by default a new one. ``status``
    gets (fold, algo, ok or failed, message).
    """
    data = stored(training).persist(StorageLevel.MEMORY_AND_DISK)
    folds = usable_folds(data)
    if not folds:
        raise ValueError("no fold holds presences and background")
    jobs = [(k, a) for k in folds for a in algorithms]
    profiles = {k: Profile.of(data.filter(F.col("cv_fold") != k), predictors) for k in folds}

    def one(job: tuple[int, str]) -> Model | None:
        k, a = job
        return attempt(lambda: fit(data.filter(F.col("cv_fold") != k), predictors, a, overrides, profiles[k]), status, k, a)

    with ThreadPoolExecutor(threads) as pool:
        fitted = dict(zip(jobs, pool.map(one, jobs)))
    path = path or scratch_folder(data.sparkSession)
    for k in folds:
        models = {a: fitted[k, a] for a in algorithms if fitted[k, a] is not None}
        split = F.when(F.col("cv_fold") == k, "test").otherwise("train")
        part = score_all(models, data, algorithms).select("*", F.lit(k).alias("held_out"), split.alias("split"))
        part.write.mode("append").parquet(path)  # scored once, read by every metric
    data.unpersist()
    return data.sparkSession.read.parquet(path)


def save(models: Mapping[str, Model], meta: DataFrame, path: str) -> None:
    """Store the pipelines and a table of weights, thresholds and shifts."""
    for a, m in models.items():
        m.pipeline.write().overwrite().save(f"{path}/{a}")
    spark = meta.sparkSession
    shifts = spark.createDataFrame([(a, m.shift, m.predictors) for a, m in models.items()], "algo string, shift double, predictors array<string>")
    shifts.join(meta, "algo", "left").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_pipeline(spark: SparkSession, path: str) -> PipelineModel | Forest:
    trees = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/trees")
    if trees.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(trees):
        return Forest.load(spark, path)
    return PipelineModel.load(path)


def load(spark: SparkSession, path: str) -> tuple[dict[str, Model], DataFrame]:
    meta = spark.read.parquet(f"{path}/meta")
    rows = meta.select("algo", "shift", "predictors").collect()  # one row per algorithm
    models = {r["algo"]: Model(r["algo"], r["predictors"], load_pipeline(spark, f"{path}/{r['algo']}"), r["shift"]) for r in rows}
    return models, meta
