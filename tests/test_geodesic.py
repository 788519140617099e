"""Geodesics against independent figures, and the centroid filter across the date line and around a pole."""

import math

import numpy as np

from habitspark import settings as S
from habitspark.functions.geo import geodesic_m
from habitspark.operators import cleaning, spatial


def meridian_m(lat1, lat2):
    """Length of a meridian by numeric integration of its radius of curvature."""
    e2 = S.WGS84_F * (2 - S.WGS84_F)
    x, w = np.polynomial.legendre.leggauss(40)
    a, b = math.radians(lat1), math.radians(lat2)
    t = (b - a) / 2 * x + (a + b) / 2
    return float(np.sum(w * S.WGS84_A_M * (1 - e2) / (1 - e2 * np.sin(t) ** 2) ** 1.5) * (b - a) / 2)


def test_geodesic(spark):
    degree = S.WGS84_A_M * math.pi / 180
    dms = lambda d, m, s: math.copysign(abs(d) + m / 60 + s / 3600, d)
    want = [
        (0.0, 0.0, 1.0, 0.0, degree),
        (179.5, 0.0, -179.5, 0.0, degree),
        (20.0, 60.0, 20.0, 60.0, 0.0),
        (180.0, -5.0, -180.0, -5.0, 0.0),
        # a surveyed line
        (dms(144, 25, 29.52440), dms(-37, 57, 3.72030), dms(143, 55, 35.38390), dms(-37, 39, 10.15610), 54972.271),
        *[(7.0, a, 7.0, b, meridian_m(a, b)) for a, b in [(0, 1), (10, 10.009), (-60, 60), (45, 89.99), (-89.5, -88)]],
    ]
    rows = [(i, *[float(v) for v in w[:4]]) for i, w in enumerate(want)] + [(99, None, 1.0, 2.0, 3.0)]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "i int, a double, b double, c double, d double").select("i", geodesic_m(*[_c(n) for n in "abcd"])).collect()}
    for i, w in enumerate(want):
        assert abs(got[i] - w[4]) < 1e-3, (w, got[i])
    assert got[99] is None


def _c(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_centroids_across_the_date_line_and_at_a_pole(spark):
    centroids = spark.createDataFrame([(179.999, 10.0), (-180.0, -30.0), (40.0, 89.9999), (5.0, 5.0), (None, 1.0)], "lon double, lat double")
    rows = [
        ("over the line", -179.999, 10.0, False), ("on the line", 180.0, -30.0, False), ("west of it", 179.995, -30.0, False), ("too far", -179.98, 10.0, True),
        ("pole", -140.0, 89.9999, False), ("off the pole", -140.0, 89.98, True), ("near", 5.0, 5.009, False), ("outside", 5.0, 5.0091, True),
        ("no place", None, None, True),
    ]
    points = spark.createDataFrame([r[:3] for r in rows], "name string, lon double, lat double")
    left = {r.name for r in spatial.away_from_centroids(points, centroids, 1.0).collect()}
    assert left == {r[0] for r in rows if r[3]}


def test_funnel_counts_each_step_once(spark):
    df = spark.range(100).toDF("x")
    last, report = cleaning.funnel(df, [("even", lambda d: d.filter("x % 2 = 0")), ("none", lambda d: d.filter("x < 0")), ("still", lambda d: d)])
    got = [tuple(r) for r in report.orderBy("step_no").collect()]
    assert got == [(1, "even", 100, 50, 50, 50.0), (2, "none", 50, 0, 50, 0.0), (3, "still", 0, 0, 0, None)]
    assert last.count() == 0
