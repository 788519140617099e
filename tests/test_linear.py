"""Models of many species fitted together: conditions of the optimum, a dense solver, and scores recomputed in SQL."""

import math
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from habitspark.operators import linear as L
from habitspark.operators import models as MD

NAMES = ["a", "b", "c"]
HINGES = {"maxent": {"features": ("linear", "quadratic", "product", "hinge"), "hinges": 4}}


def rows_of(species, n, seed, folds=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3)) * [1.0, 5.0, 0.1] + [0.0, 20.0, 1.0]
    eta = x[:, 0] - 0.2 * (x[:, 1] - 20) + np.sin(x[:, 0] * 2)
    y = (r.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    return [(species, int(k % folds), int(v), *map(float, row)) for k, (row, v) in enumerate(zip(x, y))]


KIND = "species string, cv_fold int, presence int, a double, b double, c double"


@pytest.fixture(scope="module")
def data():
    return rows_of("s1", 400, 1) + rows_of("s2", 150, 2)


@pytest.fixture(scope="module", params=["1000000", "20"], ids=["one task", "rounds over tasks"])
def fitted(spark, data, request):
    spark.conf.set("habitspark.window.maxGroupRows", request.param)
    chosen = spark.createDataFrame([("s1", 1, "a"), ("s1", 2, "b"), ("s1", 3, "c"), ("s2", 1, "c"), ("s2", 2, "a"), ("s3", 1, "a")], "species string, position int, predictor string")
    training = spark.createDataFrame(data, KIND)
    table = L.fit_linear(training, chosen, NAMES, overrides=HINGES)
    yield training, table, {(r.species, r.held_out, r.algo): r for r in table.collect()}
    spark.conf.unset("habitspark.window.maxGroupRows")


def parts(data, species, held_out):
    rows = [r for r in data if r[0] == species and r[1] != held_out]
    return np.array([r[3:] for r in rows]), np.array([r[2] for r in rows])


def smooth_gradient(z, y, weight, beta):
    w = np.where(y == 1, 1.0, weight)
    return z.T @ (w * (1 / (1 + np.exp(-z @ beta)) - y))


def test_every_species_fold_and_algorithm_has_a_model(fitted):
    _, _, models = fitted
    assert set(models) == {(s, k, a) for s in ("s1", "s2") for k in (None, 0, 1, 2) for a in L.LINEAR}
    assert {m.status for m in models.values()} == {"ok"}
    assert models["s1", None, "glm"].n_pred == 3 and models["s2", 0, "gam"].n_pred == 2


@pytest.mark.parametrize("species, own", [("s1", [0, 1, 2]), ("s2", [2, 0])])
@pytest.mark.parametrize("held_out", [None, 1])
def test_glm_meets_the_conditions_of_its_optimum(fitted, data, species, own, held_out):
    m = fitted[2][species, held_out, "glm"]
    x, y = parts(data, species, held_out)
    z = np.c_[np.ones(len(x)), ((x - x.mean(0)) / x.std(0))[:, own]]
    beta = np.r_[m.intercept, np.zeros(len(own))]
    for t in m.terms:
        beta[1 + own.index(t.term.a)] = t.coefficient
    g = smooth_gradient(z, y, y.sum() / (y == 0).sum(), beta)
    assert abs(g[0]) < 1e-5
    for slope, b in zip(g[1:], beta[1:]):
        assert abs(slope + math.copysign(1, b)) < 1e-5 if b else abs(slope) <= 1 + 1e-9


def maxent_terms(x, y, own):
    """Terms by hand, with their penalties."""
    u = (x - x.min(0)) / (x.max(0) - x.min(0))
    columns = {("unit", i, i, 0.0): u[:, i] for i in own}
    columns |= {("product", i, j, 0.0): u[:, i] * u[:, j] for i, j in [*zip(own, own), *combinations(own, 2)]}
    for i in own:
        for k in (0.2, 0.4, 0.6, 0.8):
            columns["hinge", i, i, k] = np.maximum(u[:, i] - k, 0) / (1 - k)
            columns["reverse", i, i, k] = np.maximum(k - u[:, i], 0) / k
    n = y.sum()
    penalty = {}
    for key, v in columns.items():
        sd = v[y == 1].std(ddof=1)
        each = 0.5 * max(sd, 1 / math.sqrt(n)) if key[0] in ("hinge", "reverse") else MD.regularisation(int(n)) * sd
        penalty[key] = 1.5 * n * max(each / math.sqrt(n), 0.001)
    return columns, penalty


@pytest.mark.parametrize("species, own, held_out", [("s1", [0, 1, 2], None), ("s1", [0, 1, 2], 2), ("s2", [2, 0], 0)])
def test_maxent_has_a_penalty_per_term(fitted, data, species, own, held_out):
    m = fitted[2][species, held_out, "maxent"]
    x, y = parts(data, species, held_out)
    columns, penalty = maxent_terms(x, y, own)
    found = {(t.term.kind, t.term.a, t.term.b, round(t.term.knot, 6)): t.coefficient for t in m.terms}
    assert set(found) <= set(columns) and found
    keys = list(columns)
    z = np.c_[np.ones(len(x)), np.array([columns[k] for k in keys]).T]
    beta = np.array([m.intercept, *[found.get(k, 0.0) for k in keys]])
    g = smooth_gradient(z, y, 100.0, beta)
    scale = max(penalty.values())
    assert abs(g[0]) < 1e-4 * scale
    for k, slope, b in zip(keys, g[1:], beta[1:]):
        assert abs(slope + math.copysign(penalty[k], b)) < 1e-4 * scale if b else abs(slope) <= penalty[k] + 1e-4 * scale
    # normaliser and entropy over the background
    eta = (z @ beta)[y == 0]
    raw = np.exp(eta) / np.exp(eta).sum()
    assert m.shift == pytest.approx(-math.log(np.exp(eta).sum()) - (raw * np.log(raw)).sum(), abs=1e-9)


def spline_basis(u, n):
    """Cubic B-splines by the recursion over degrees, on equal knots."""
    h = 1.0 / (n - 3)
    knots = h * np.arange(-3, n + 1)
    u = np.minimum(u, 1 - 1e-12)
    basis = [(u >= knots[k]) & (u < knots[k + 1]) for k in range(n + 3)]
    basis = [b.astype(float) for b in basis]
    for degree in (1, 2, 3):
        basis = [
            (u - knots[k]) / (knots[k + degree] - knots[k]) * basis[k] + (knots[k + degree + 1] - u) / (knots[k + degree + 1] - knots[k + 1]) * basis[k + 1]
            for k in range(len(basis) - 1)
        ]
    return np.array(basis).T


@pytest.mark.parametrize("species, own, held_out", [("s1", [0, 1, 2], None), ("s2", [2, 0], 1)])
def test_additive_model_matches_a_dense_solver(fitted, data, species, own, held_out):
    training, table, _ = fitted
    x, y = parts(data, species, held_out)
    u = (x - x.min(0)) / (x.max(0) - x.min(0))
    z = np.hstack([np.ones((len(x), 1)), *[spline_basis(u[:, i], 20) for i in own]])
    d = np.diff(np.eye(20), 2, axis=0)
    p = np.zeros((z.shape[1],) * 2)
    for k in range(len(own)):
        s = slice(1 + 20 * k, 21 + 20 * k)
        p[s, s] = 0.6 * d.T @ d + L.RIDGE * np.eye(20)
    w = np.where(y == 1, 1.0, y.sum() / (y == 0).sum())
    beta = np.zeros(z.shape[1])
    for _ in range(100):
        mu = 1 / (1 + np.exp(-z @ beta))
        beta = beta - np.linalg.solve(z.T @ (z * (w * mu * (1 - mu))[:, None]) + p, z.T @ (w * (mu - y)) + p @ beta)
    want = 1 / (1 + np.exp(-z @ beta))
    own_rows = training.filter(F.col("species") == species)
    if held_out is None:
        got = L.score_models(own_rows, table, NAMES)
    else:
        got = L.cross_scores(own_rows, table, NAMES).filter((F.col("held_out") == held_out) & (F.col("split") == "train"))
    found = {(r.a, r.b, r.c): r.gam for r in got.collect()}
    assert max(abs(found[tuple(map(float, row))] - v) for row, v in zip(x, want)) < 1e-6


def test_scores_follow_from_the_coefficient_table_in_sql(fitted):
    training, table, _ = fitted
    con = duckdb.connect()
    rows = training.toPandas()
    rows["id"] = range(len(rows))
    con.register("rows", rows)
    con.register("terms", L.coefficient_table(table.filter("held_out IS NULL"), NAMES).toPandas())
    unit = "CASE WHEN clamp THEN least(greatest((v{s} - low_{s}) / span_{s}, 0), 1) ELSE (v{s} - low_{s}) / span_{s} END"
    sql = con.sql(
        f"""WITH long AS (UNPIVOT rows ON a, b, c INTO NAME predictor VALUE v),
        valued AS (SELECT t.*, x.id, x.v AS va, y.v AS vb FROM terms t JOIN long x ON x.species = t.species AND x.predictor = t.a JOIN long y ON y.id = x.id AND y.predictor = t.b),
        units AS (SELECT *, {unit.format(s="a")} AS ua, {unit.format(s="b")} AS ub FROM valued),
        terms_of AS (SELECT *, abs(ua * span_b - (knot - 1)) AS d FROM units),
        sums AS (SELECT id, algo, any_value(intercept) + sum(coefficient * CASE kind WHEN 'scaled' THEN (va - low_a) / span_a WHEN 'unit' THEN ua WHEN 'product' THEN ua * ub
          WHEN 'hinge' THEN greatest(ua - knot, 0) / (1 - knot) WHEN 'reverse' THEN greatest(knot - ua, 0) / knot
          ELSE CASE WHEN d < 1 THEN (4 - 6 * d * d + 3 * d * d * d) / 6 WHEN d < 2 THEN (2 - d) * (2 - d) * (2 - d) / 6 ELSE 0 END END) AS eta, any_value(shift) AS shift
          FROM terms_of GROUP BY 1, 2)
        SELECT id, algo, CASE WHEN algo = 'maxent' THEN 1 - exp(-exp(eta + shift)) ELSE 1 / (1 + exp(-eta)) END FROM sums"""
    ).fetchall()
    want = {(i, a): s for i, a, s in sql}
    scored = L.score_models(training.sparkSession.createDataFrame(rows), table, NAMES).collect()
    got = {(r["id"], a): r[a] for r in scored for a in L.LINEAR}
    assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_size_paths_and_empty_tables(spark, tight, data):
    chosen = spark.createDataFrame([("s2", 1, "a")], "species string, position int, predictor string")
    training = spark.createDataFrame([r for r in data if r[0] == "s2"] + [("s9", 0, 1, 1.0, 1.0, 1.0)], KIND)
    table = L.fit_linear(training, chosen.union(spark.createDataFrame([("s9", 1, "a")], chosen.schema)), NAMES, ["glm"], folds=False)
    assert [(r.species, r.held_out, r.status) for r in table.collect()] == [("s2", None, "ok")]
    scored = L.score_models(training, table, NAMES, ["glm"]).collect()
    assert all((r.glm is None) == (r.species == "s9") for r in scored) and len(scored) == len(training.collect())
    assert L.fit_linear(training.limit(0), chosen, NAMES).collect() == []
