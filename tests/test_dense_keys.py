"""Dense tiles, boxes and bins: answers stay those of brute force and no key holds more than it may."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from habitspark.operators import spatial
from habitspark.plans import proximity, scale


def _inside(x, y, ring):
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            hit = not hit
    return hit


def _edges(spark, rings):
    rows = [(k, *map(float, a), *map(float, b)) for k, ring in rings.items() for a, b in zip(ring, ring[1:])]
    return spark.createDataFrame(rows, "feature_id int, x1 double, y1 double, x2 double, y2 double")


def _rings(rng):
    star = [(8 * r * math.cos(t), 5 * r * math.sin(t)) for t, r in zip(np.linspace(0, 2 * math.pi, 200, endpoint=False), rng.uniform(0.4, 1, 200))]
    # corners and sides on the borders of the tiles, a slope through tile corners, a comb with most edges in one band
    steps = [(0, 0), (2, 0), (2, 0.5), (1, 0.5), (1, 1), (3, 1), (3, 2), (1.5, 3.5), (0, 2)]
    comb = [(-6.0, -3.0)] + [(-6 + 0.02 * i, 0.2 if i % 2 else 0.4) for i in range(600)] + [(6.0, -3.0)]
    blob = [(float(round(8 * a) / 4), float(round(8 * b) / 4)) for a, b in rng.uniform(-1, 1, (12, 2))]
    return {k: [*r, r[0]] for k, r in enumerate((star, steps, comb, blob, [(10, 10), (10.1, 10), (10.1, 10.1)]))}


def _asked(rng):
    free = rng.uniform(-9, 9, (400, 2))
    lattice = [(x / 4, y / 4) for x in range(-13, 14) for y in range(-13, 14)]
    return [(i, float(x), float(y)) for i, (x, y) in enumerate([*free.tolist(), *lattice, (10.05, 10.02), (10.0, 10.05)])]


@pytest.mark.parametrize("limit", ["67108864", "0"])
def test_points_in_polygons_by_tile(spark, limit):
    rng = np.random.default_rng(11)
    rings, asked = _rings(rng), _asked(rng)
    points = spark.createDataFrame([*asked, (-1, None, 1.0)], "id int, lon double, lat double")
    spark.conf.set(scale.BROADCAST_BYTES_CONF, limit)
    try:
        got = {(r["id"], r["feature_id"]) for r in spatial.covering(points, _edges(spark, rings), ["id"]).collect()}
    finally:
        spark.conf.unset(scale.BROADCAST_BYTES_CONF)
    assert got == {(i, k) for i, x, y in asked for k, ring in rings.items() if _inside(x, y, ring)}


def test_a_tile_holds_its_own_edges_only(spark):
    rings = {k: r for k, r in _rings(np.random.default_rng(11)).items() if k == 2}
    index = spatial.tile_index(_edges(spark, rings))
    most = index.groupBy("_tx", "_ty").count().agg(F.max("count")).first()[0]
    # 600 edges in one band of latitude, 25 to a tile and some on its borders
    assert most < 40
    assert index.filter("x1 is null").groupBy("_tx", "_ty").count().filter("count > 1").isEmpty()


def test_a_city_is_quartered(spark):
    rng = np.random.default_rng(2)
    city = rng.normal([-60.1, -10.2], 0.01, (3000, 2))
    rest = rng.uniform([-62, -12], [-58, -8], (40, 2))
    rows = [("a", float(x), float(y)) for x, y in np.vstack([city, city[:50], rest])]
    points = spark.createDataFrame(rows, "species string, lon double, lat double")
    cells = [(r, c, -63 + c / 12, -8 - r / 12) for r in range(60) for c in range(60)]
    grid = spark.createDataFrame([(r, c, float(x), float(y)) for r, c, x, y in cells], "row long, col long, lon double, lat double")
    spark.conf.set(proximity.BOX_POINTS_CONF, "50")
    try:
        placed = proximity._placed(points, ["species"], 0.25)
        assert placed.count() == 3040
        assert placed.groupBy(*proximity.BOX).count().agg(F.max("count")).first()[0] <= 50
        found = {(r["row"], r["col"]): r["distance_km"] for r in proximity.nearest(points, grid, ["species"], 80.0).collect()}
        near = sorted((r["row"], r["col"]) for r in proximity.within(points, grid, ["species"], 80.0).collect())
    finally:
        spark.conf.unset(proximity.BOX_POINTS_CONF)
    xy = np.radians(np.vstack([city, rest]))
    want = {}
    for r, c, x, y in cells:
        x, y = math.radians(x), math.radians(y)
        h = np.sin((xy[:, 1] - y) / 2) ** 2 + np.cos(y) * np.cos(xy[:, 1]) * np.sin((xy[:, 0] - x) / 2) ** 2
        km = float(2 * proximity.S.EARTH_KM * np.arcsin(np.sqrt(h)).min())
        if km <= 80:
            want[r, c] = km
    assert near == sorted(want) == sorted(found)
    assert all(found[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())


@pytest.mark.parametrize("n", [0, 1, 137, 1999, 5000])
def test_draws_that_fall_into_one_bin(spark, n):
    rng = np.random.default_rng(4)
    draws = [0.25 + d * 2.0**-40 for d in rng.random(1500).tolist()] + [0.5] * 400 + rng.random(100).tolist()
    rows = [(g, i, d) for g in ("a", "b") for i, d in enumerate(draws)] + [("c", i, 0.125) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, id int, draw double")
    spark.conf.set(scale.GROUP_ROWS_CONF, "64")
    try:
        got = sorted((r["g"], r["id"]) for r in scale.take_smallest(df, ["g"], "draw", n, ["id"]).collect())
    finally:
        spark.conf.unset(scale.GROUP_ROWS_CONF)
    first = lambda g: [i for _, i in sorted((d, i) for k, i, d in rows if k == g)[:n]]
    assert got == sorted((g, i) for g in "abc" for i in first(g))
