"""Fold clusters: ten starts, one answer on both size paths, and a search by hand."""

import numpy as np
import pytest

from habitspark.operators import folds as FD


def presences(spark):
    r = np.random.default_rng(4)
    spots = [(s, float(np.round(x, 3)), float(np.round(y, 3))) for s, n in (("a", 300), ("b", 40)) for x, y in r.normal(size=(n, 2)) * [4, 2] + [-70, -30]]
    spots += [("c", -60.0, -10.0)] * 5 + [("c", -61.0, -10.0)] + spots[:50]
    return spark.createDataFrame(spots, "species string, lon double, lat double"), spots


def inertia(spots, centres, species):
    own = np.array([s[1:] for s in spots if s[0] == species])
    scale = np.cos(np.radians(own[:, 1].mean()))
    x, y = own[:, 0] * scale, own[:, 1]
    c = np.array([(r.x, r.y) for r in centres if r.species == species])
    d = (x[:, None] - c[:, 0]) ** 2 + (y[:, None] - c[:, 1]) ** 2
    near = d.argmin(axis=1)
    means = np.array([[x[near == j].mean(), y[near == j].mean()] for j in range(len(c))])
    return d.min(axis=1).sum(), np.abs(means - c).max()


def test_more_starts_never_cost_more(spark):
    df, spots = presences(spark)
    one, ten = (FD.presence_clusters(df, starts=n)[0].collect() for n in (1, 10))
    for species in ("a", "b"):
        least, moves = inertia(spots, ten, species)
        assert moves <= 1e-4 and least <= inertia(spots, one, species)[0] + 1e-9
    assert sorted((r.species, r.cluster) for r in ten) == [*[(s, k) for s in "ab" for k in range(5)], ("c", 0), ("c", 1)]


def test_best_of_ten_starts_by_hand(spark):
    df, spots = presences(spark)
    centres = FD.presence_clusters(df)[0].collect()
    own = np.array([s[1:] for s in spots if s[0] == "a"])
    x, y = own[:, 0] * np.cos(np.radians(own[:, 1].mean())), own[:, 1]
    draw = np.random.default_rng(0)
    best = np.inf
    for _ in range(40):
        pick = draw.choice(len(x), 5, replace=False)
        c = np.c_[x[pick], y[pick]]
        for _ in range(200):
            near = ((x[:, None] - c[:, 0]) ** 2 + (y[:, None] - c[:, 1]) ** 2).argmin(axis=1)
            c = np.array([[x[near == j].mean(), y[near == j].mean()] if (near == j).any() else c[j] for j in range(5)])
        best = min(best, ((x[:, None] - c[:, 0]) ** 2 + (y[:, None] - c[:, 1]) ** 2).min(axis=1).sum())
    assert inertia(spots, centres, "a")[0] <= best * 1.05


def test_both_size_paths_agree(spark, request):
    df, _ = presences(spark)
    small = {(r.species, r.cluster): (r.x, r.y) for r in FD.presence_clusters(df)[0].collect()}
    request.getfixturevalue("tight")
    large = {(r.species, r.cluster): (r.x, r.y) for r in FD.presence_clusters(df)[0].collect()}
    assert set(small) == set(large) and all(small[k] == pytest.approx(large[k], abs=1e-9) for k in small)


def test_no_presences(spark):
    df, _ = presences(spark)
    assert FD.presence_clusters(df.limit(0))[0].collect() == []
