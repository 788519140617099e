"""Models sent to the rows: the same scores as by a join, rows stay where they are, trees as bits give the leaves of a walk."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from habitspark.operators import boosting as B
from habitspark.operators import linear as L
from habitspark.plans import scale

NAMES = ["a", "b", "c"]


def rows_of(species, n, seed):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 3)), 2)
    y = (r.random(n) < 1 / (1 + np.exp(-2 * x[:, 0] - np.sign(x[:, 1])))).astype(int)
    return [(species, k, int(k % 3), int(v), *map(float, row)) for k, (row, v) in enumerate(zip(x, y))]


@pytest.mark.parametrize("change", [{}, {"num_leaves": 2}, {"num_leaves": 60, "min_child_samples": 2}, {"num_leaves": 90, "min_child_samples": 2}])
def test_bits_give_the_leaves_of_a_walk(change):
    data = np.array([r[3:] for r in rows_of("s", 600, 7)])
    x, y = data[:, 1:], data[:, 0]
    m = B.boost(x, y, np.ones(600), {**B.SETTINGS, "rounds": 12, **change})
    scorer = B.Scorer(m)
    assert (scorer.trees is None) == (change.get("num_leaves") == 90)
    asked = np.vstack([x, np.random.default_rng(1).normal(size=(40_000, 3)) * 3])
    walked = B._walk(asked, *[np.array(m[c]) for c in ("feature", "threshold", "below", "above", "value", "roots")])
    assert np.array_equal(scorer(asked), 1 / (1 + np.exp(-(m["base"] + walked))))


def test_models_go_to_the_rows(spark, monkeypatch):
    monkeypatch.setattr(scale, "SCORED_ROWS", 50)
    kind = "species string, id int, cv_fold int, presence int, a double, b double, c double"
    training = spark.createDataFrame(rows_of("s1", 150, 1) + rows_of("s2", 90, 2), kind)
    chosen = spark.createDataFrame([("s1", 0, "a"), ("s1", 1, "b"), ("s2", 0, "c")], "species string, position int, predictor string")
    linear, boosted = L.fit_linear(training, chosen, NAMES), B.fit_boosted(training, chosen, NAMES, {"rounds": 10})
    asked = training.withColumn("a", F.when(F.col("id") % 7 > 0, F.col("a"))).unionByName(training.filter("id < 5").withColumn("species", F.lit("s3")))
    columns = [*L.LINEAR, "gbm"]

    def score():
        whole = B.score_boosted(L.score_models(asked, linear, NAMES), boosted.filter("held_out IS NULL"), NAMES)
        folds = B.score_boosted(L.cross_scores(training, linear, NAMES), boosted, NAMES, ["species", "held_out"])
        return whole, folds

    def values(df, *keys):
        return {tuple(r[k] for k in keys): [r[c] for c in columns] for r in df.collect()}

    whole, folds = score()
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan and "Exchange" not in plan
    here = [values(whole, "species", "id"), values(folds, "species", "id", "held_out")]
    spark.conf.set(scale.BROADCAST_BYTES_CONF, "1")
    try:
        whole, folds = score()
        joined = [values(whole, "species", "id"), values(folds, "species", "id", "held_out")]
    finally:
        spark.conf.unset(scale.BROADCAST_BYTES_CONF)
    assert [len(v) for v in here] == [245, 720]
    for a, b in zip(here, joined):
        assert a.keys() == b.keys()
        for k in a:
            assert [v is None for v in a[k]] == [v is None for v in b[k]], k
            assert all(v is None or abs(v - w) < 1e-12 for v, w in zip(a[k], b[k])), k
    assert here[0]["s3", 0] == [None] * 4 and here[0]["s1", 7] == [None] * 4 and None not in here[0]["s2", 7]
