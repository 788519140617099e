"""Forests grown in tasks: splits against a search, the same trees whatever the limits, no trees on the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from habitspark.operators import forest as FO
from habitspark.operators import models as MD
from habitspark.plans import scale

NAMES = ["a", "b", "c"]
SMALL = {"numTrees": 7, "maxDepth": 30, "minInstancesPerNode": 1, "featureSubsetStrategy": "sqrt"}


def table(spark, n=300, seed=1):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 3)), 2)
    y = (r.random(n) < 1 / (1 + np.exp(-2 * x[:, 0] - np.sign(x[:, 1])))).astype(int)
    rows = [(i, int(v), *map(float, row)) for i, (v, row) in enumerate(zip(y, x))]
    rows += [(n + i, *r[1:]) for i, r in enumerate(rows[:40])]  # equal rows
    return spark.createDataFrame(rows, "row_id int, presence int, a double, b double, c double"), rows


def search(codes, y, w, tree, path, q):
    """Share of presences of every row by a tree grown with a loop over all splits."""
    out = {}

    def impurity(rows):
        p, n = float((w[rows] * y[rows]).sum()), float((w[rows] * (1 - y[rows])).sum()) * q.background
        return p + n - (p * p + n * n) / (p + n)

    def node(rows, asked, path, depth):
        p, n = (w[rows] * y[rows]).sum(), (w[rows] * (1 - y[rows])).sum()
        best = (1e-9, None, None)
        if p and n and depth < q.depth:
            for f in FO.tried(np.array([path]), tree, q)[0]:
                for cut in np.unique(codes[rows, f])[:-1]:
                    low = codes[rows, f] <= cut
                    if min(w[rows[low]].sum(), w[rows[~low]].sum()) < q.least:
                        continue
                    gain = impurity(rows) - impurity(rows[low]) - impurity(rows[~low])
                    if gain > best[0] + 1e-9:
                        best = (gain, f, cut)
        if best[1] is None:
            out.update({i: p / (p + n * q.background) for i in asked})
            return
        for side, above in ((2 * path, False), (2 * path + 1, True)):
            node(rows[(codes[rows, best[1]] > best[2]) == above], asked[(codes[asked, best[1]] > best[2]) == above], side, depth + 1)

    node(np.flatnonzero(w > 0), np.arange(len(w)), path, 0)
    return np.array([out[i] for i in range(len(w))])


@pytest.mark.parametrize("least, depth, background", [(1, 30, 1.0), (8, 30, 0.37), (1, 4, 2.5)])
def test_trees_match_a_search(least, depth, background):
    r = np.random.default_rng(5)
    codes = r.integers(0, 12, (250, 4)).astype(np.uint8)
    y = (r.random(250) < codes[:, 0] / 12).astype(np.uint8)
    q = FO.Settings(3, depth, least, 2, background, 4)
    for tree in range(3):
        w = FO.draws(r.integers(-(2**62), 2**62, 250), np.ones(250, np.int64), tree, q.seed)
        grown = FO.grow(codes, w * y, w * (1 - y.astype(np.int64)), tree, FO.ROOT, q)
        assert np.allclose(FO.walk(codes, grown), search(codes, y.astype(np.int64), w, tree, FO.ROOT, q))


def test_draws_are_those_of_rows_drawn_with_replacement():
    one = FO.draws(np.arange(200_000), np.ones(200_000, np.int64), 3, 42)
    assert abs(one.mean() - 1) < 0.01 and abs(one.var() - 1) < 0.02 and abs((one == 0).mean() - np.exp(-1)) < 0.01
    many = FO.draws(np.arange(3000), np.full(3000, 1000), 3, 42)
    assert abs(many.mean() - 1000) < 3 and abs(many.var() / 1000 - 1) < 0.1


def scores(model, df):
    return {r["row_id"]: r["rf"] for r in model.score(df).select("row_id", "rf").collect()}


def test_full_forests_are_tables_and_keep_every_tree(spark):
    df, rows = table(spark)
    model = MD.fit(df, NAMES, "rf")
    assert isinstance(model.pipeline, FO.Forest)  # nothing of the trees is on the driver
    trees = model.pipeline.trees
    assert trees.filter("part = 1").select("tree").distinct().count() == trees.count() == 300
    y = {r[0]: r[1] for r in rows}
    got = scores(model, df)
    assert len(got) == 340 and sum((got[i] > 0.5) == (y[i] == 1) for i in y) > 320
    holes = df.withColumn("b", F.when(F.col("row_id") % 9 > 0, F.col("b")))
    assert all((v is None) == (i % 9 == 0) and (v is None or v == pytest.approx(got[i])) for i, v in scores(model, holes).items())


@pytest.mark.parametrize("limit", ["20", "150"])
def test_branches_make_the_same_trees(spark, monkeypatch, limit):
    monkeypatch.setattr(MD, "DRIVER_NODES", 0)
    monkeypatch.setattr(FO, "SLICE_ROWS", 100)
    df, _ = table(spark, 900, 4)
    whole = MD.fit(df, NAMES, "rf", {"rf": SMALL})
    spark.conf.set(scale.GROUP_ROWS_CONF, limit)
    try:
        apart = MD.fit(df.repartition(3), NAMES, "rf", {"rf": SMALL})
    finally:
        spark.conf.unset(scale.GROUP_ROWS_CONF)
    assert apart.pipeline.trees.count() > whole.pipeline.trees.count() == 7
    assert apart.pipeline.edges == whole.pipeline.edges
    a, b = scores(whole, df), scores(apart, df)
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-12 for i in a)


def test_stored_forests_score_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(MD, "DRIVER_NODES", 0)
    df, _ = table(spark)
    model = MD.fit(df, NAMES, "rf", {"rf": SMALL})
    weights = spark.createDataFrame([("rf", 1.0)], "algo string, weight double")
    MD.save({"rf": model}, weights, f"{tmp_path}/m")
    again, _ = MD.load(spark, f"{tmp_path}/m")
    a, b = scores(model, df), scores(again["rf"], df)
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-12 for i in a)


def test_bins(spark):
    df = spark.range(5000).select((F.col("id") % 7).cast("double").alias("few"), (F.col("id") * F.col("id")).cast("double").alias("many"), F.lit(1.0).alias("one"))
    few, many, one = FO.edges_of(df, ["few", "many", "one"])
    assert few == [0.5, 1.5, 2.5, 3.5, 4.5, 5.5] and one == [] and len(many) == FO.BINS - 1
    held = np.bincount(np.searchsorted(np.array(many), np.arange(5000.0) ** 2))
    assert held.min() >= 19 and held.max() <= 20
