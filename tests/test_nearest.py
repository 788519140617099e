"""Nearest points by tree and lattice: answers of brute force, few comparisons where points are dense, tiles of bounded size."""

import numpy as np
import pytest

from habitspark.plans import nearest, proximity


def brute(lon, lat, asked_lon, asked_lat):
    return np.array([nearest._haversine(lon, lat, a, b).min() for a, b in zip(asked_lon, asked_lat)])


@pytest.mark.parametrize("seed", range(24))
def test_answers_of_brute_force(seed):
    r = np.random.default_rng(seed)
    n, wide = int(r.integers(1, 900)), [1e-9, 1e-4, 0.1, 3, 50, 400][seed % 6]
    lon = (r.normal(r.choice([0, -60, 179.9]), wide, n) + 180) % 360 - 180
    lat = np.clip(r.normal(r.choice([0, -50, 89.5, -89.9]), wide / 2, n), -90, 90)
    if seed % 5 == 0:
        lat[:] = lat[0]
    lon, lat = np.r_[lon, lon[:20]], np.r_[lat, lat[:20]]
    asked_lon = (np.r_[r.normal(lon[0], wide * 2, 150), lon[:10], r.uniform(-180, 180, 20)] + 180) % 360 - 180
    asked_lat = np.clip(np.r_[r.normal(lat[0], wide, 150), lat[:10], r.uniform(-90, 90, 20)], -90, 90)
    want = brute(lon, lat, asked_lon, asked_lat)
    assert np.abs(nearest.nearest_km(lon, lat, asked_lon, asked_lat) - want).max() < 1e-7
    near = nearest.nearest_km(lon, lat, asked_lon, asked_lat, 200.0)
    assert np.abs(near - want)[want <= 200].max(initial=0) < 1e-7 and (near[want > 200] > 200).all()


def test_dense_points_take_few_comparisons(monkeypatch):
    seen = [0]
    length = nearest._length

    def counted(v):
        seen[0] += len(v)
        return length(v)

    monkeypatch.setattr(nearest, "_length", counted)
    r = np.random.default_rng(0)
    lon, lat = r.uniform(0, 2, 100_000), r.uniform(-20, -18, 100_000)
    asked_lon, asked_lat = r.uniform(0.2, 1.8, 5000), r.uniform(-19.8, -18.2, 5000)
    got = nearest.nearest_km(lon, lat, asked_lon, asked_lat)
    assert seen[0] < 60 * 5000  # of 100 000 each
    assert np.abs(got[:200] - brute(lon, lat, asked_lon[:200], asked_lat[:200])).max() < 1e-9


def test_tiles_are_made_smaller(spark):
    r = np.random.default_rng(1)
    xy = np.round(r.uniform([-61, -11], [-58, -8], (2000, 2)), 4)
    points = spark.createDataFrame([("ab"[i % 2], *map(float, p)) for i, p in enumerate(xy)], "species string, lon double, lat double")
    cells = [(i, j, -63 + j / 5, -13 + i / 5) for i in range(40) for j in range(40)]
    grid = spark.createDataFrame([(i, j, float(x), float(y)) for i, j, x, y in cells], "row long, col long, lon double, lat double")

    def run():
        return {(r["species"], r["row"], r["col"]): r["distance_km"] for r in proximity.nearest(points, grid, ["species"], 250.0).collect()}

    whole = run()
    spark.conf.set(proximity.TILE_POINTS_CONF, "150")
    try:
        boxes = proximity._boxes(proximity._placed(points, ["species"], 0.25), ["species"])
        counts = proximity._placed(points, ["species"], 0.25).groupBy("species", *proximity.BOX).count().withColumnRenamed("count", "b_points")
        tiled, pairs, _ = proximity._open_tiles(boxes.join(counts, ["species", *proximity.BOX]), grid, ["species"], 250.0, 2.0)
        most = pairs.join(counts, ["species", *proximity.BOX]).groupBy("species", *proximity.TILE).sum("b_points").agg({"sum(b_points)": "max"}).first()[0]
        small = run()
    finally:
        spark.conf.unset(proximity.TILE_POINTS_CONF)
    assert most <= 150 and tiled.select(*proximity.TILE).distinct().count() > 16
    assert small == whole
    for k, s in enumerate("ab"):
        want = brute(xy[k::2, 0], xy[k::2, 1], np.array([c[2] for c in cells]), np.array([c[3] for c in cells]))
        inside = {(i, j): d for (i, j, _, _), d in zip(cells, want) if d <= 250}
        assert inside.keys() == {key[1:] for key in whole if key[0] == s}
        assert all(abs(whole[s, i, j] - d) < 1e-9 for (i, j), d in inside.items())
