"""Penalised logistic models of many species and folds, fitted together.

A model is a list of *terms* of the predictors with one coefficient each, so linear, additive (splines) and maximum-entropy
models (linear, quadratic, product, hinge) share one fit and one scoring expression. It minimises

    sum of weight * log-loss  +  sum of l1_j * |coefficient_j|  +  coefficients' P coefficients / 2

with a free intercept. Training rows are written once as packed pieces, clustered by species and fold; a species of any size
is many pieces. Species of at most ``habitspark.window.maxGroupRows`` rows go through all rounds in one task each. For larger
ones, each round is one pass over the pieces for all models still running: a task adds up loss, gradient and curvature of
its pieces, the sums are added per model in two steps, and one small task per model takes a proximal Newton step. What
moves between tasks then grows with models and terms, not with rows. Both take the same steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from itertools import combinations
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitspark.operators.models import parameters, regularisation
from habitspark.plans.scale import attach, broadcast_bytes_limit, group_rows_limit, scored_in_place, stored

LINEAR = ("glm", "gam", "maxent")
PIECE_ROWS = 4096
TASK_ROWS = 250_000
PARTS = 32
MOST_TASKS = 10_000
RIDGE = 1e-6  # splines of a predictor add up to one, so their level is only fixed by this
TOLERANCE = 1e-12
TERM_BYTES = 100
MOST_ROUNDS = 100
# Penalty of hinge terms and floors of penalties of the published method.
HINGE_REGULARISATION = 0.5
LEAST_PENALTY = 0.001

TERM = "struct<kind:string,a:int,b:int,low_a:double,span_a:double,low_b:double,span_b:double,knot:double,clamp:boolean>"
MODEL = f"species string, held_out int, algo string, n_pres long, n_bg long, n_pred int, weight double, lam double, terms array<{TERM}>, l1 array<double>"
STATE = MODEL + ", beta array<double>, last array<double>, move array<double>, share double, value double, rounds int, status string"
KEYS = ["species", "held_out", "algo"]


# ---- terms


def _term(kind: str, a: int, low: Sequence[float], span: Sequence[float], clamp: bool, b: int | None = None, knot: float = 0.0) -> dict[str, Any]:
    other = a if b is None else b
    return {"kind": kind, "a": a, "b": other, "low_a": low[a], "span_a": span[a], "low_b": low[other], "span_b": span[other], "knot": knot, "clamp": clamp}


def terms_of(algo: str, own: Sequence[int], stats: Mapping[str, np.ndarray], q: Mapping[str, Any]) -> list[dict[str, Any]]:
    """Terms of an algorithm on the predictors at positions ``own``; ``stats`` holds mean, sd, low and high of each."""
    if algo == "glm":
        return [_term("scaled", a, stats["mean"].tolist(), np.where(stats["sd"] > 0, stats["sd"], 1.0).tolist(), False) for a in own]
    low = stats["low"].tolist()
    span = np.where(stats["high"] > stats["low"], stats["high"] - stats["low"], 1.0).tolist()
    if algo == "gam":
        n = int(q["n_splines"])
        return [_term("spline", a, low, span, True, knot=float(k), b=None) | {"span_b": float(n - 3)} for a in own for k in range(n)]
    clamp, features = bool(q["clamp"]), q["features"]
    out = []
    if "linear" in features:
        out += [_term("unit", a, low, span, clamp) for a in own]
    if "quadratic" in features:
        out += [_term("product", a, low, span, clamp) for a in own]
    if "product" in features:
        out += [_term("product", a, low, span, clamp, b) for a, b in combinations(own, 2)]
    if "hinge" in features:
        knots = [k / (int(q["hinges"]) + 1) for k in range(1, int(q["hinges"]) + 1)]
        out += [_term(kind, a, low, span, clamp, knot=k) for a in own for kind in ("hinge", "reverse") for k in knots]
    return out


def design(x: np.ndarray, terms: Sequence[Mapping[str, Any]]) -> np.ndarray:
    """Values of the terms, one column each, with a leading column of ones."""
    out = np.ones((len(x), len(terms) + 1))

    def unit(t, side):
        v = (x[:, t[side]] - t[f"low_{side}"]) / t[f"span_{side}"]
        return np.clip(v, 0.0, 1.0) if t["clamp"] else v

    for j, t in enumerate(terms, 1):
        kind = t["kind"]
        if kind == "scaled":
            out[:, j] = (x[:, t["a"]] - t["low_a"]) / t["span_a"]
        elif kind == "unit":
            out[:, j] = unit(t, "a")
        elif kind == "product":
            out[:, j] = unit(t, "a") * unit(t, "b")
        elif kind == "hinge":
            out[:, j] = np.maximum(unit(t, "a") - t["knot"], 0.0) / (1.0 - t["knot"])
        elif kind == "reverse":
            out[:, j] = np.maximum(t["knot"] - unit(t, "a"), 0.0) / t["knot"]
        else:
            d = np.abs(unit(t, "a") * t["span_b"] - (t["knot"] - 1.0))
            out[:, j] = np.where(d < 1, (4 - 6 * d**2 + 3 * d**3) / 6, np.where(d < 2, (2 - d) ** 3 / 6, 0.0))
    return out


def _value(t: Column, x: Column) -> Column:
    """Value of one term as a column, the same as a column of ``design``."""

    def unit(side: str) -> Column:
        v = (F.get(x, t[side]) - t[f"low_{side}"]) / t[f"span_{side}"]
        return F.when(t["clamp"], F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))).otherwise(v)

    kind, knot, u = t["kind"], t["knot"], unit("a")
    d = F.abs(u * t["span_b"] - (knot - 1.0))
    spline = F.when(d < 1, (4 - 6 * d * d + 3 * d * d * d) / 6).when(d < 2, (2 - d) * (2 - d) * (2 - d) / 6).otherwise(0.0)
    return (
        F.when(kind == "scaled", (F.get(x, t["a"]) - t["low_a"]) / t["span_a"])
        .when(kind == "unit", u)
        .when(kind == "product", u * unit("b"))
        .when(kind == "hinge", F.greatest(u - knot, F.lit(0.0)) / (1 - knot))
        .when(kind == "reverse", F.greatest(knot - u, F.lit(0.0)) / knot)
        .otherwise(spline)
    )


# ---- training rows and models


def pieces(training: DataFrame, names: Sequence[str]) -> DataFrame:
    """Packed rows per species and fold: ``species``, ``cv_fold``, ``x`` (doubles by row), ``y`` (one byte a row)."""
    kept = stored(training.select("species", F.col("cv_fold").cast("int").alias("cv_fold"), F.col("presence").cast("int").alias("presence"), *[F.col(n).cast("double").alias(n) for n in names]))
    spark = training.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-kept.count() // TASK_ROWS))
    # the id spreads a species of many rows over tasks; it belongs to rows of a written table, so it does not change
    dealt = kept.withColumn("_id", F.monotonically_increasing_id()).repartitionByRange(n, "species", "cv_fold", "_id").drop("_id")
    return stored(dealt.sortWithinPartitions("species", "cv_fold").mapInArrow(_packed, "species string, cv_fold int, x binary, y binary"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        frame = batch.to_pandas()
        rows = []
        for (species, fold), part in frame.groupby(["species", "cv_fold"], sort=False, dropna=False):
            for at in range(0, len(part), PIECE_ROWS):
                some = part.iloc[at : at + PIECE_ROWS]
                rows.append((species, int(fold), some.iloc[:, 3:].to_numpy(np.float64).tobytes(), some["presence"].to_numpy(np.uint8).tobytes()))
        kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], ["species", "cv_fold", "x", "y"])


def plan_models(training: DataFrame, chosen: DataFrame, names: Sequence[str], algorithms: Sequence[str] = LINEAR, overrides=None, folds: bool = True) -> DataFrame:
    """One row per model: every species and algorithm on all rows (``held_out`` null), and without each usable fold.

    A fold is usable if it holds both classes and leaves both. Statistics of a model come from one aggregate per species and
    fold. ``chosen`` has ``species``, ``position``, ``predictor``. A species without both classes has no models.
    """
    aggs = [F.count_if(F.col("presence") == 1).alias("p"), F.count_if(F.col("presence") == 0).alias("b")]
    for i, n in enumerate(names):
        v = F.col(n).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.var_pop(v).alias(f"v{i}"), F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}")]
    per_fold = training.groupBy("species", "cv_fold").agg(*aggs)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "predictor"))), lambda p: p["predictor"])
    lists = chosen.groupBy("species").agg(ordered.alias("predictors"))
    settings = {a: parameters(a, overrides) for a in algorithms}

    def plan(frame: pd.DataFrame) -> pd.DataFrame:
        own = [names.index(p) for p in frame["predictors"].iloc[0]]
        p, b = frame["p"].to_numpy(), frame["b"].to_numpy()
        usable = (p > 0) & (b > 0) & (p < p.sum()) & (b < b.sum())
        held = [None, *frame["cv_fold"][usable].tolist()] if folds else [None]
        rows = []
        for fold in held:
            part = frame if fold is None else frame[frame["cv_fold"] != fold]
            n_pres, n_bg = int(part["p"].sum()), int(part["b"].sum())
            if not n_pres or not n_bg:
                continue
            stats = _statistics(part, len(names))
            for algo, q in settings.items():
                terms = terms_of(algo, own, stats, q)
                weight = float(q["background_weight"]) if algo == "maxent" else n_pres / n_bg
                l1 = [1.0 / q["C"] if algo == "glm" else 0.0] * len(terms)
                rows.append((frame["species"].iloc[0], fold, algo, n_pres, n_bg, len(own), weight, float(q.get("lam", 0.0)), terms, l1))
        return pd.DataFrame(rows, columns=_FIT).astype({"held_out": "Int32"})

    names = list(names)
    # five folds or so per species: a small group whatever the number of rows
    return per_fold.join(lists, "species").groupBy("species").applyInPandas(plan, MODEL)


def _statistics(part: pd.DataFrame, n: int) -> dict[str, np.ndarray]:
    out: dict[str, list[float]] = {"mean": [], "sd": [], "low": [], "high": []}
    for i in range(n):
        some = part[part[f"n{i}"] > 0]
        count = some[f"n{i}"].to_numpy(float)
        total = count.sum()
        if not total:
            for v in out.values():
                v.append(0.0)
            continue
        mean = float((count * some[f"m{i}"]).sum() / total)
        spread = float((count * (some[f"v{i}"] + (some[f"m{i}"] - mean) ** 2)).sum() / total)
        for key, v in (("mean", mean), ("sd", math.sqrt(spread)), ("low", float(some[f"l{i}"].min())), ("high", float(some[f"h{i}"].max()))):
            out[key].append(v)
    return {k: np.array(v) for k, v in out.items()}


FITTED = (
    "species string, held_out int, algo string, n_pres long, n_bg long, n_pred int, intercept double, shift double, "
    f"terms array<struct<term:{TERM},coefficient:double>>, value double, rounds int, status string"
)
_COMMON = ["species", "held_out", "algo", "n_pres", "n_bg", "n_pred"]
_FIT = [*_COMMON, "weight", "lam", "terms", "l1"]
COLUMNS = {
    MODEL: _FIT,
    STATE: [*_FIT, "beta", "last", "move", "share", "value", "rounds", "status"],
    FITTED: [*_COMMON, "intercept", "shift", "terms", "value", "rounds", "status"],
}


# ---- sums over pieces


def _of_rows(m: Mapping[str, Any], x: np.ndarray, y: np.ndarray, mode: str) -> np.ndarray:
    if mode == "terms":
        z = design(x[y == 1], m["terms"])
        return np.concatenate([z.sum(0), (z * z).sum(0)])
    beta = np.array(m["beta"])
    if mode == "shift":
        return _shifted(design(x[y == 0], m["terms"]) @ beta)
    z = design(x, m["terms"])
    eta = z @ beta
    w = np.where(y == 1, 1.0, m["weight"])
    mu = 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700)))
    loss = (w * np.logaddexp(0.0, np.where(y == 1, -eta, eta))).sum()
    return np.concatenate([[loss], z.T @ (w * (mu - y)), (z.T @ (z * (w * mu * (1 - mu))[:, None])).ravel()])


def _added(width: int, mode: str):
    """Sums over the pieces of a task, one row per model.

    ``fit``: loss, gradient, curvature. ``terms``: number, sums and squares of terms over presences. ``shift``: largest linear
    score over the background, and the sums of its weights and weighted scores relative to that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() % PARTS
        sums: dict[tuple, np.ndarray] = {}
        held = 0
        for batch in batches:
            for species, fold, x, y, models in zip(*[batch.column(c) for c in range(5)]):
                values = np.frombuffer(x.as_buffer(), np.float64).reshape(-1, width)
                labels = np.frombuffer(y.as_buffer(), np.uint8)
                for m in models.as_py():
                    if m["held_out"] == fold.as_py():
                        continue
                    key = (species.as_py(), m["held_out"], m["algo"])
                    new = _of_rows(m, values, labels, mode)
                    held += 0 if key in sums else new.nbytes
                    sums[key] = new if key not in sums else _joined(sums[key], new, mode)
                if held > 64 << 20:
                    yield _sent(sums, part)
                    sums, held = {}, 0
        yield _sent(sums, part)

    return run


def _shifted(eta: np.ndarray) -> np.ndarray:
    top = eta.max() if len(eta) else -math.inf
    w = np.exp(eta - top) if len(eta) else eta
    return np.array([top, w.sum(), (w * eta).sum()])


def _joined(a: np.ndarray, b: np.ndarray, mode: str) -> np.ndarray:
    if mode != "shift":
        return a + b
    top = max(a[0], b[0])
    if top == -math.inf:
        return a
    return np.concatenate([[top], a[1:] * math.exp(a[0] - top) + b[1:] * math.exp(b[0] - top)])


SUMS = "species string, held_out int, algo string, part int, sums binary"


def _sent(sums: Mapping[tuple, np.ndarray], part: int) -> pa.RecordBatch:
    rows = [(*k, part, v.tobytes()) for k, v in sums.items()]
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], ["species", "held_out", "algo", "part", "sums"])


def _total(mode: str):
    def run(table: pa.Table) -> pa.Table:
        total = None
        for raw in table["sums"]:
            new = np.frombuffer(raw.as_buffer(), np.float64)
            total = new.copy() if total is None else _joined(total, new, mode)
        first = table.slice(0, 1)
        return first.set_column(4, "sums", pa.array([total.tobytes()], pa.binary()))

    return run


def _sums(packed: DataFrame, models: DataFrame, width: int, mode: str) -> DataFrame:
    """Added-up sums per model, in two steps so that a species of many tasks is no hot key."""
    fields = ["held_out", "algo", "weight", "terms", *(["beta"] if mode != "terms" else [])]
    per_species = models.groupBy("species").agg(F.collect_list(F.struct(*fields)).alias("models"))
    given = attach(packed, per_species, ["species"]).select("species", "cv_fold", "x", "y", "models")
    added = given.mapInArrow(_added(width, mode), SUMS)
    few = packed.rdd.getNumPartitions() <= PARTS  # at most one row per task and model, a few dozen in all
    for keys in [KEYS] if few else ([*KEYS, "part"], KEYS):
        added = added.groupBy(*keys).applyInArrow(_total(mode), SUMS)
    return added.select(*KEYS, "sums")


def _with_sums(models: DataFrame, sums: DataFrame) -> DataFrame:
    return models.alias("m").join(sums.alias("s"), [F.col(f"m.{k}").eqNullSafe(F.col(f"s.{k}")) for k in KEYS]).select("m.*", "s.sums")


# ---- steps


def _penalty(terms: Sequence[Mapping[str, Any]], lam: float) -> np.ndarray:
    """Matrix of the quadratic penalty: second differences of the spline coefficients of a predictor."""
    out = np.zeros((len(terms) + 1, len(terms) + 1))
    spline = [j for j, t in enumerate(terms, 1) if t["kind"] == "spline"]
    for a in sorted({terms[j - 1]["a"] for j in spline}):
        own = [j for j in spline if terms[j - 1]["a"] == a]
        d = np.diff(np.eye(len(own)), 2, axis=0)
        out[np.ix_(own, own)] += lam * d.T @ d + RIDGE * np.eye(len(own))
    return out


def _newton(beta: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """Coefficients that minimise the quadratic approximation plus the l1 penalty, by coordinate descent."""
    q = curvature + 1e-12 * np.trace(curvature) / len(beta) * np.eye(len(beta))
    if not l1.any():
        return beta - np.linalg.solve(q, gradient)
    new, slope, diagonal = beta.copy(), gradient.copy(), np.diag(q)
    for sweep in range(2000):
        # every tenth sweep looks at all coordinates, the others at those in use
        most = 0.0
        for j in range(len(new)) if sweep % 10 == 0 else np.flatnonzero((new != 0) | (l1 == 0)):
            at = new[j] - slope[j] / diagonal[j]
            to = math.copysign(max(abs(at) - l1[j] / diagonal[j], 0.0), at)
            if to != new[j]:
                step = to - new[j]
                slope += q[:, j] * step
                new[j] = to
                most = max(most, step * step * diagonal[j])
        if sweep % 10 == 0 and most < 1e-16 or sweep % 10 and most < 1e-18 and sweep % 10 == 9:
            break
    return new


def _advanced(r: dict[str, Any], sums: np.ndarray) -> dict[str, Any]:
    """One step of a model: shorten the last move if it went up, else take the next one or stop."""
    n = len(r["terms"]) + 1
    loss, gradient, curvature = sums[0], sums[1 : n + 1], sums[n + 1 :].reshape(n, n)
    beta, l1 = np.array(r["beta"], float), np.r_[0.0, np.array(r["l1"], float)]
    p = _penalty(r["terms"], r["lam"])
    value = float(loss + (l1 * np.abs(beta)).sum() + beta @ p @ beta / 2)
    before = r["value"]
    known = before is not None and before == before
    r = {**r, "rounds": r["rounds"] + 1}
    if known and value > before + 1e-13 * abs(before):
        r["share"] /= 2
        if r["share"] < 1e-10:
            r |= {"beta": r["last"], "status": "ok"}
        else:
            r["beta"] = (np.array(r["last"], float) + r["share"] * np.array(r["move"], float)).tolist()
    else:
        settled = known and before - value <= TOLERANCE * (1 + abs(value))
        new = beta if settled else _newton(beta, gradient + p @ beta, curvature + p, l1)
        if settled or not np.isfinite(new).all():
            r["status"] = "ok" if settled else "failed"
        else:
            r |= {"last": beta.tolist(), "move": (new - beta).tolist(), "share": 1.0, "beta": new.tolist()}
        r["value"] = value
    if r["status"] == "running" and r["rounds"] >= MOST_ROUNDS:
        r["status"] = "not converged"
    return r


def _penalised(r: dict[str, Any], sums: np.ndarray, beta_factor: float) -> dict[str, Any]:
    """The l1 penalty of every maximum-entropy term from its spread over the presences."""
    sums = sums.reshape(2, -1)
    n = sums[0, 0]
    mean = sums[0, 1:] / n
    sd = np.sqrt(np.maximum(sums[1, 1:] / n - mean**2, 0.0) * (n / max(n - 1, 1)))
    hinge = np.array([t["kind"] in ("hinge", "reverse") for t in r["terms"]], bool)
    factor = np.where(hinge, HINGE_REGULARISATION * np.maximum(sd, 1 / math.sqrt(n)), regularisation(int(n)) * sd)
    return {**r, "l1": (beta_factor * np.maximum(factor / math.sqrt(n), LEAST_PENALTY) * n).tolist()}


def _started(r: dict[str, Any]) -> dict[str, Any]:
    first = math.log(r["n_pres"] / (r["n_bg"] * r["weight"]))
    return {**r, "beta": [first, *[0.0] * len(r["terms"])], "last": [], "move": [], "share": 1.0, "value": None, "rounds": 0, "status": "running"}


def _frame(rows: list[dict[str, Any]], kind: str) -> pd.DataFrame:
    names = COLUMNS[kind]
    return pd.DataFrame([{k: r[k] for k in names} for r in rows], columns=names).astype({"held_out": "Int32"})


def _each(step, kind: str):
    """``step(model, its sums or None)`` for every row of a table of models."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                raw = r.pop("sums", None)
                rows.append(step(r, None if raw is None else np.frombuffer(raw, np.float64)))
            yield _frame(rows, kind)

    return run


def _finished(r: dict[str, Any], sums: np.ndarray | None) -> dict[str, Any]:
    shift = 0.0
    if sums is not None:
        top, z, ze = sums
        normaliser = -(top + math.log(z))
        shift = float(normaliser - (ze / z + normaliser))
    beta = np.array(r["beta"], float)
    used = [{"term": t, "coefficient": float(c)} for t, c in zip(r["terms"], beta[1:]) if c != 0]
    return {**r, "intercept": float(beta[0]), "shift": shift, "terms": used}


def _in_one_task(packed: DataFrame, models: DataFrame, width: int, factor: float) -> DataFrame:
    """All rounds of the models of species whose rows fit into a task, by the same steps."""

    def fit(part: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        x = {int(k): np.concatenate([np.frombuffer(v).reshape(-1, width) for v in g["x"]]) for k, g in part.groupby("cv_fold")}
        y = {int(k): np.concatenate([np.frombuffer(v, np.uint8) for v in g["y"]]) for k, g in part.groupby("cv_fold")}
        out = []
        for r in own.to_dict("records"):
            held = None if pd.isna(r["held_out"]) else int(r["held_out"])
            rows = (np.concatenate([v for k, v in t.items() if k != held]) for t in (x, y))
            values, labels = rows
            r = {**r, "held_out": held}
            if r["algo"] == "maxent":
                r = _penalised(r, _of_rows(r, values, labels, "terms"), factor)
            r = _started(r)
            while r["status"] == "running":
                r = _advanced(r, _of_rows(r, values, labels, "fit"))
            out.append(_finished(r, _of_rows(r, values, labels, "shift") if r["algo"] == "maxent" else None))
        return _frame(out, FITTED)

    # species take long for few rows, so tasks are dealt by their number and not by bytes
    spark = models.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(models.select("species").distinct().count(), MOST_TASKS))
    own = packed.join(models.select("species").distinct(), "species", "left_semi").repartition(n, "species")
    return own.groupBy("species").cogroup(models.repartition(n, "species").groupBy("species")).applyInPandas(fit, FITTED)


def _over_tasks(packed: DataFrame, models: DataFrame, width: int, factor: float) -> DataFrame:
    """Rounds over all pieces for the models of species of any size."""
    some = models.filter("algo = 'maxent'")
    scaled = _with_sums(some, _sums(packed, some, width, "terms")).mapInPandas(_each(lambda r, s: _penalised(r, s, factor), MODEL), MODEL)
    models = models.filter("algo <> 'maxent'").unionByName(scaled)
    running = stored(models.mapInPandas(_each(lambda r, _: _started(r), STATE), STATE))
    done: list[DataFrame] = []
    while not running.isEmpty():
        stepped = stored(_with_sums(running, _sums(packed, running, width, "fit")).mapInPandas(_each(_advanced, STATE), STATE))
        done.append(stepped.filter("status <> 'running'"))
        running = stepped.filter("status = 'running'")
    ended = stored(reduce(DataFrame.unionByName, done, running))
    cloglog = ended.filter("algo = 'maxent'")
    plain = ended.filter("algo <> 'maxent'").withColumn("sums", F.lit(None).cast("binary"))
    return plain.unionByName(_with_sums(cloglog, _sums(packed, cloglog, width, "shift"))).mapInPandas(_each(_finished, FITTED), FITTED)


def fit_linear(training: DataFrame, chosen: DataFrame, names: Sequence[str], algorithms: Sequence[str] = LINEAR, overrides=None, folds: bool = True) -> DataFrame:
    """All linear-in-terms models of all species: one row per species, left-out fold (null: none) and algorithm.

    ``training`` has species, cv_fold, presence and ``names``, complete in the predictors that ``chosen`` lists for the
    species. Columns: counts, ``intercept``, ``shift`` (turns a maximum-entropy score into cloglog), ``terms`` with
    coefficients other than zero, objective ``value``, ``rounds`` and ``status``: ok, not converged or failed. A species
    without both classes, and an empty table, give no row.
    """
    names = list(names)
    packed = pieces(training, names)
    models = stored(plan_models(training, chosen, names, algorithms, overrides, folds))
    factor = float(parameters("maxent", overrides)["beta"])
    limit = group_rows_limit(training.sparkSession)
    sizes = training.groupBy("species").agg(F.count(F.lit(1)).alias("_rows"))
    sized = stored(models.join(sizes, "species"))
    small, large = (sized.filter(c).drop("_rows") for c in (F.col("_rows") <= limit, F.col("_rows") > limit))
    fitted = _in_one_task(packed, small, len(names), factor)
    if not large.isEmpty():
        fitted = fitted.unionByName(_over_tasks(packed, large, len(names), factor))
    return stored(fitted)


def suitability(x: np.ndarray, algo: str, terms: Sequence[Mapping[str, Any]], beta: np.ndarray, shift: float, used: Sequence[int]) -> np.ndarray:
    """The same as ``linear_score`` on columns of ``x``; NaN where one of the ``used`` is."""
    out = np.empty(len(x))
    for at in range(0, len(x), PIECE_ROWS):
        some = x[at : at + PIECE_ROWS]
        with np.errstate(over="ignore", invalid="ignore"):
            eta = design(some, terms) @ beta
            out[at : at + PIECE_ROWS] = 1 - np.exp(-np.exp(eta + shift)) if algo == "maxent" else 1 / (1 + np.exp(-eta))
        out[at : at + PIECE_ROWS][np.isnan(some[:, used]).any(axis=1)] = np.nan
    return out


def coefficient_table(fitted: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per model and term: what is needed to score with plain SQL."""
    t = fitted.select(*KEYS, "intercept", "shift", F.explode("terms").alias("t")).select(*KEYS, "intercept", "shift", "t.term.*", "t.coefficient")
    name = F.array(*[F.lit(n) for n in names])
    return t.withColumns({"a": F.get(name, F.col("a")), "b": F.get(name, F.col("b"))})


def linear_score(names: Sequence[str], model: Column) -> Column:
    """Suitability of a row under the model in the struct column ``model`` (algo, intercept, shift, terms); null where a predictor of the model is."""
    x = F.array(*[F.col(n).cast("double") for n in names])
    eta = F.aggregate(model["terms"], model["intercept"], lambda total, t: total + t["coefficient"] * _value(t["term"], x))
    # splines and clamped terms would take a missing value for the lowest one
    gone = lambda t: F.get(x, t["a"]).isNull() | ((t["kind"] == "product") & F.get(x, t["b"]).isNull())
    missing = F.exists(model["terms"], lambda t: gone(t["term"]))
    return F.when(~missing, F.when(model["algo"] == "maxent", 1 - F.exp(-F.exp(eta + model["shift"]))).otherwise(1 / (1 + F.exp(-eta))))


def score_models(rows: DataFrame, fitted: DataFrame, names: Sequence[str], algorithms: Sequence[str] = LINEAR) -> DataFrame:
    """Rows of ``species`` with a column per algorithm, from its models on all rows; null where a species has none.

    The models of a species are one row of the lookup, joined by species.
    """
    return _scored(rows, fitted.filter("held_out IS NULL"), names, algorithms, ["species"])


def cross_scores(training: DataFrame, fitted: DataFrame, names: Sequence[str], algorithms: Sequence[str] = LINEAR) -> DataFrame:
    """Every row under the models of every left-out fold of its species: ``held_out``, ``split`` (test or train) and a column per algorithm."""
    left_out = fitted.filter("held_out IS NOT NULL")
    held = attach(training, left_out.groupBy("species").agg(F.collect_set("held_out").alias("_held")), ["species"])
    rows = held.withColumn("held_out", F.explode("_held")).drop("_held")
    rows = rows.withColumn("split", F.when(F.col("cv_fold") == F.col("held_out"), "test").otherwise("train"))
    return _scored(rows, left_out, names, algorithms, ["species", "held_out"])


def _scored(rows: DataFrame, fitted: DataFrame, names: Sequence[str], algorithms: Sequence[str], keys: list[str]) -> DataFrame:
    ready = fitted.filter("status = 'ok'")
    size = ready.agg(F.sum(F.size("terms") + 1)).first()[0] or 0
    if size * TERM_BYTES <= broadcast_bytes_limit(rows.sparkSession):
        sent: dict[tuple, dict[str, tuple]] = {}
        for r in ready.select(*keys, "algo", "intercept", "shift", "terms").collect():
            terms = [t["term"].asDict() for t in r["terms"]]
            used = sorted({t["a"] for t in terms} | {t["b"] for t in terms if t["kind"] == "product"})
            beta = np.array([r["intercept"], *[t["coefficient"] for t in r["terms"]]])
            sent.setdefault(tuple(r[k] for k in keys), {})[r["algo"]] = (terms, beta, r["shift"], used)
        wanted = list(algorithms)

        def in_place(key: tuple, x: np.ndarray) -> list[np.ndarray]:
            own = sent.get(key, {})
            return [suitability(x, a, *own[a]) if a in own else np.full(len(x), np.nan) for a in wanted]

        return scored_in_place(rows, keys, names, wanted, in_place)
    one = lambda a: F.first(F.when(F.col("algo") == a, F.struct("intercept", "shift", "terms", "algo")), True).alias(f"_m_{a}")
    lookup = ready.groupBy(*keys).agg(*[one(a) for a in algorithms])
    joined = attach(rows, lookup, keys, "left")
    scores = {a: linear_score(names, F.col(f"_m_{a}")) for a in algorithms}
    return joined.withColumns(scores).drop(*[f"_m_{a}" for a in algorithms])
