"""Leaf-wise boosting: gains and leaves against a search over all splits, settings, slices and sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from habitspark.operators import boosting as B

NAMES = ["a", "b", "c"]


def rows_of(species, n, seed):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 3)), 2)
    y = (r.random(n) < 1 / (1 + np.exp(-2 * x[:, 0] - np.sign(x[:, 1])))).astype(int)
    return [(species, int(k % 3), int(v), *map(float, row)) for k, (row, v) in enumerate(zip(x, y))]


KIND = "species string, cv_fold int, presence int, a double, b double, c double"


def brute_split(x, g, h, lam, least):
    best = (0.0, None, None)
    for k in range(x.shape[1]):
        for cut in np.unique(x[:, k])[:-1]:
            under = x[:, k] <= cut
            if under.sum() < least or (~under).sum() < least:
                continue
            part = lambda m: g[m].sum() ** 2 / (h[m].sum() + lam)
            gain = part(under) + part(~under) - g.sum() ** 2 / (h.sum() + lam)
            if gain > best[0] + 1e-9:
                best = (gain, k, cut)
    return best


@pytest.mark.parametrize("lam, least", [(0.0, 1), (3.0, 20)])
def test_split_gains_match_a_search(lam, least):
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(200, 3)), 1)
    g, h = r.normal(size=200), r.random(200) + 0.1
    edges = [B.bin_edges(x[:, k]) for k in range(3)]
    codes = np.array([np.searchsorted(e, x[:, k]) for k, e in enumerate(edges)]).T
    table = B.histogram(codes, max(map(len, edges)) + 1, g, h, np.ones(200))
    gain, feature, last = B.best_split(table, lam, least, np.ones(3, bool))
    want = brute_split(x, g, h, lam, least)
    assert gain == pytest.approx(want[0]) and feature == want[1]
    assert ((x[:, feature] <= edges[feature][last]) == (x[:, feature] <= want[2])).all()


def test_first_tree_takes_the_best_leaf_each_time():
    data = np.array([r[2:] for r in rows_of("s", 300, 5)])
    x, y = data[:, 1:], data[:, 0]
    q = {**B.SETTINGS, "rounds": 1, "num_leaves": 6}
    m = B.boost(x, y, np.ones(300), q)
    mu = y.mean()
    g, h = mu - y, np.full(300, mu * (1 - mu))
    leaves = [np.arange(300)]
    while len(leaves) < 6:
        splits = [brute_split(x[r], g[r], h[r], 0.0, 20) for r in leaves]
        k = max(range(len(leaves)), key=lambda i: splits[i][0])
        _, f, cut = splits[k]
        r = leaves.pop(k)
        leaves += [r[x[r, f] <= cut], r[x[r, f] > cut]]
    want = np.empty(300)
    for r in leaves:
        want[r] = m["base"] - 0.1 * g[r].sum() / h[r].sum()
    assert np.abs(B.predict(x, m) - 1 / (1 + np.exp(-want))).max() < 1e-12


@pytest.mark.parametrize("change", [{"num_leaves": 4}, {"reg_lambda": 50.0}, {"colsample_bytree": 0.34}, {"subsample": 0.5}, {"learning_rate": 0.02}])
def test_settings_take_effect(change):
    data = np.array([r[2:] for r in rows_of("s", 300, 7)])
    x, y = data[:, 1:], data[:, 0]
    plain, other = (B.boost(x, y, np.ones(300), {**B.SETTINGS, "rounds": 20, **c}) for c in ({}, change))
    assert np.abs(B.predict(x, plain) - B.predict(x, other)).max() > 1e-3
    if "num_leaves" in change:
        assert len(other["feature"]) <= 20 * 7


def test_models_of_species_and_folds(spark, monkeypatch):
    monkeypatch.setattr(B, "SLICE_ROWS", 40)
    training = spark.createDataFrame(rows_of("s1", 200, 1) + rows_of("s2", 90, 2) + [("s3", 0, 1, 0.0, 0.0, 0.0)], KIND)
    chosen = spark.createDataFrame([("s1", "a"), ("s1", "b"), ("s2", "c"), ("s3", "a")], "species string, predictor string")
    fitted = B.fit_boosted(training, chosen, NAMES, {"rounds": 15})
    assert sorted((r.species, -1 if r.held_out is None else r.held_out) for r in fitted.collect()) == [(s, k) for s in ("s1", "s2") for k in (-1, 0, 1, 2)]
    whole = B.score_boosted(training.withColumn("c", F.when(F.col("a") < 1, F.col("c"))), fitted.filter("held_out IS NULL"), NAMES).collect()
    assert len(whole) == 291
    data = np.array([r[2:] for r in rows_of("s1", 200, 1)])
    m = B.boost(data[:, 1:3], data[:, 0], np.where(data[:, 0] == 1, 1.0, data[:, 0].sum() / (data[:, 0] == 0).sum()), {**B.SETTINGS, "rounds": 15})
    got = {(r.a, r.b): r.gbm for r in whole if r.species == "s1"}
    assert all(abs(got[a, b] - v) < 1e-12 for (a, b), v in zip(data[:, 1:3], B.predict(data[:, 1:3], m)))
    for r in whole:
        assert (r.gbm is None) == (r.species == "s3" or (r.species == "s2" and r.c is None))


def test_large_species_are_reported_and_empty_tables_pass(spark, tight):
    training = spark.createDataFrame(rows_of("s1", 60, 1) + rows_of("s2", 18, 2), KIND)
    chosen = spark.createDataFrame([("s1", "a"), ("s2", "b")], "species string, predictor string")
    fitted = B.fit_boosted(training, chosen, NAMES, {"rounds": 3}, folds=False)
    assert {(r.species, r.status) for r in fitted.collect()} == {("s1", "too large"), ("s2", "ok")}
    assert B.fit_boosted(training.limit(0), chosen, NAMES).collect() == []
    with pytest.raises(ValueError):
        B.fit_boosted(training, chosen, NAMES, {"depth": 3})
