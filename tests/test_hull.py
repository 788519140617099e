"""Hulls: inner points are dropped before any Python, and the answer is that of all points."""

import numpy as np

from habitspark.operators import spatial


def ring(hull, species):
    rows = hull[hull["species"] == species].sort_values("seq")
    return rows[["lon", "lat"]].to_numpy()


def test_inner_points_never_reach_the_exact_hull(spark):
    r = np.random.default_rng(6)
    disc = r.normal(size=(60_000, 2))
    disc = np.round(disc / np.linalg.norm(disc, axis=1)[:, None] * np.sqrt(r.random(60_000))[:, None] * 20 - 40, 5)
    square = np.array([[x, y] for x in range(30) for y in range(30)], float)
    line = np.array([[k, 2 * k] for k in range(50)], float)
    sets = {"disc": disc, "square": square, "line": line, "one": np.array([[3.0, 4.0]] * 5), "two": np.array([[0.0, 0.0], [1.0, 1.0]] * 3)}
    rows = [(name, float(a), float(b)) for name, xy in sets.items() for a, b in xy] + [("disc", None, 1.0), ("null", None, None)]
    points = spark.createDataFrame(rows, "species string, lon double, lat double")
    left = {k: n for k, n in spatial.outer_points(points).groupBy("species").count().collect()}
    assert left["disc"] < 0.02 * len(disc) and left["square"] <= 4 * 30 and set(left) == set(sets)
    hull = spatial.convex_hull(points).toPandas()
    for name, xy in sets.items():
        assert np.array_equal(ring(hull, name), spatial._turn_hull(xy)), name


def test_both_size_paths(spark, tight):
    r = np.random.default_rng(7)
    rows = [(s, float(a), float(b)) for s in "ab" for a, b in np.round(r.random((300, 2)), 2)]
    hull = spatial.convex_hull(spark.createDataFrame(rows, "species string, lon double, lat double")).toPandas()
    for s in "ab":
        assert np.array_equal(ring(hull, s), spatial._turn_hull(np.array([p[1:] for p in rows if p[0] == s])))
    assert spatial.convex_hull(spark.createDataFrame([], "species string, lon double, lat double")).collect() == []
