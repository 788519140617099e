"""Geographic column expressions. Angles are degrees, distances kilometres."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from habitspark import settings as S


@dataclass(frozen=True)
class Grid:
    """North-up regular grid: (x0, y0) is the outer corner of the first pixel."""

    x0: float
    y0: float
    dx: float
    dy: float
    width: int
    height: int

    def col_of(self, lon: Column) -> Column:
        return F.floor((lon - F.lit(self.x0)) / F.lit(self.dx))

    def row_of(self, lat: Column) -> Column:
        return F.floor((F.lit(self.y0) - lat) / F.lit(self.dy))

    def lon_of(self, col: Column) -> Column:
        return F.lit(self.x0) + (col + F.lit(0.5)) * F.lit(self.dx)

    def lat_of(self, row: Column) -> Column:
        return F.lit(self.y0) - (row + F.lit(0.5)) * F.lit(self.dy)

    def clip_col(self, col: Column) -> Column:
        return F.least(F.greatest(col, F.lit(0)), F.lit(self.width - 1))

    def clip_row(self, row: Column) -> Column:
        return F.least(F.greatest(row, F.lit(0)), F.lit(self.height - 1))

    @property
    def max_x(self) -> float:
        return self.x0 + self.dx * self.width

    @property
    def min_y(self) -> float:
        return self.y0 - self.dy * self.height


def in_bbox(lon: Column, lat: Column, bbox: tuple[float, float, float, float]) -> Column:
    min_lon, min_lat, max_lon, max_lat = bbox
    return lon.between(min_lon, max_lon) & lat.between(min_lat, max_lat)


def origin_cell(value: Column, step: float = S.GRID_STEP_DEG) -> Column:
    """Index of the thinning lattice, which starts at degree zero."""
    return F.floor(value / F.lit(step))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return arc_km(
        F.radians(lat2 - lat1),
        F.radians(lon2 - lon1),
        F.cos(F.radians(lat1)),
        F.cos(F.radians(lat2)),
    )


def arc_km(dphi: Column, dlam: Column, cos1: Column, cos2: Column) -> Column:
    """Great-circle length from latitude/longitude gaps in radians."""
    s_phi = F.sin(dphi / F.lit(2.0))
    s_lam = F.sin(dlam / F.lit(2.0))
    h = s_phi * s_phi + cos1 * cos2 * s_lam * s_lam
    return F.lit(2.0 * S.EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def ellipsoid_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """WGS-84 distance in metres from the mid-latitude radii of curvature.

    Meant for short distances (centroid checks of a few km), where it follows the
    geodesic to better than a millimetre.
    """
    e2 = S.WGS84_F * (2 - S.WGS84_F)
    mid = F.radians((lat1 + lat2) / F.lit(2.0))
    q = F.lit(1.0) - F.lit(e2) * F.sin(mid) * F.sin(mid)
    meridian = F.lit(S.WGS84_A_M * (1 - e2)) / (q * F.sqrt(q))
    vertical = F.lit(S.WGS84_A_M) / F.sqrt(q)
    north = meridian * F.radians(lat2 - lat1)
    east = vertical * F.cos(mid) * F.radians(lon2 - lon1)
    return F.sqrt(north * north + east * east)


def _named(then, **values: Column) -> Column:
    """``then`` of a struct of values, each evaluated once."""
    row = F.struct(*[v.alias(k) for k, v in values.items()])
    return F.get(F.transform(F.array(row), then), F.lit(0))


def geodesic_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, rounds: int = 8) -> Column:
    """WGS-84 geodesic in metres: the inverse problem, its longitude on the auxiliary sphere found in ``rounds`` steps.

    The shorter way round is taken, also over 180 degrees of longitude. Good to a millimetre up to three quarters of the way
    to the antipode; nearer to it the steps settle slowly. Null if an argument is null.
    """
    f, a = S.WGS84_F, S.WGS84_A_M
    b = a * (1 - f)
    reduced = lambda lat: F.atan(F.lit(1 - f) * F.tan(F.radians(lat)))
    gap = F.radians(F.pmod(lon2 - lon1 + F.lit(180.0), F.lit(360.0)) - F.lit(180.0))

    def measured(p: Column) -> Column:
        def on_sphere(lam: Column, then) -> Column:
            """``then`` of the arc (sine, cosine, length) at a longitude gap, with what depends on its azimuth."""
            x = p["c2"] * F.sin(lam)
            y = p["c1"] * p["s2"] - p["s1"] * p["c2"] * F.cos(lam)
            cos_arc = p["s1"] * p["s2"] + p["c1"] * p["c2"] * F.cos(lam)

            def azimuth(q: Column) -> Column:
                sin_az = F.when(q["s"] == 0, 0.0).otherwise(p["c1"] * p["c2"] * q["l"] / q["s"])
                return _named(middle, s=q["s"], c=q["c"], arc=F.atan2(q["s"], q["c"]), az=sin_az, h=F.lit(1.0) - sin_az * sin_az)

            def middle(q: Column) -> Column:
                # along the equator there is no middle latitude
                m = F.when(q["h"] < 1e-14, 0.0).otherwise(q["c"] - F.lit(2.0) * p["s1"] * p["s2"] / q["h"])
                return _named(then, s=q["s"], c=q["c"], arc=q["arc"], az=q["az"], h=q["h"], m=m)

            return _named(azimuth, s=F.sqrt(x * x + y * y), c=cos_arc, l=F.sin(lam))

        def next_gap(lam: Column, _: Column) -> Column:
            def then(q: Column) -> Column:
                k = F.lit(f / 16) * q["h"] * (F.lit(4.0) + F.lit(f) * (F.lit(4.0) - F.lit(3.0) * q["h"]))
                bend = q["m"] + k * q["c"] * (F.lit(2.0) * q["m"] * q["m"] - F.lit(1.0))
                return p["gap"] + (F.lit(1.0) - k) * F.lit(f) * q["az"] * (q["arc"] + k * q["s"] * bend)

            return on_sphere(lam, then)

        def length(q: Column) -> Column:
            u = q["h"] * F.lit((a * a - b * b) / (b * b))
            big = F.lit(1.0) + u / 16384 * (F.lit(4096.0) + u * (F.lit(-768.0) + u * (F.lit(320.0) - u * 175)))
            small = u / 1024 * (F.lit(256.0) + u * (F.lit(-128.0) + u * (F.lit(74.0) - u * 47)))
            twice = F.lit(2.0) * q["m"] * q["m"] - F.lit(1.0)
            third = q["m"] * (F.lit(4.0) * q["s"] * q["s"] - F.lit(3.0)) * (F.lit(4.0) * q["m"] * q["m"] - F.lit(3.0))
            return F.lit(b) * big * (q["arc"] - small * q["s"] * (q["m"] + small / 4 * (q["c"] * twice - small / 6 * third)))

        lam = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), p["gap"], next_gap)
        return _named(lambda w: on_sphere(w["lam"], length), lam=lam)

    start = {"s1": F.sin(reduced(lat1)), "c1": F.cos(reduced(lat1)), "s2": F.sin(reduced(lat2)), "c2": F.cos(reduced(lat2)), "gap": gap}
    return _named(measured, **start)


def cap_half_width_deg(lat_abs_max: Column, radius_km: float) -> Column:
    """Longitude half-width of a circle of ``radius_km`` around a latitude."""
    r = radius_km / S.EARTH_KM
    ratio = F.lit(math.sin(r)) / F.cos(F.radians(lat_abs_max))
    reaches_pole = lat_abs_max + F.lit(math.degrees(r)) >= F.lit(90.0)
    return F.when(reaches_pole, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))))


def constant_pixel_km2(step_deg: float = S.GRID_STEP_DEG) -> float:
    """Area of a pixel at the equator; the reference map tables use it everywhere."""
    r = S.WGS84_A_M / 1000.0
    return (r * math.radians(step_deg)) ** 2


def pixel_km2(lat: Column, grid: Grid) -> Column:
    """True area of a pixel of ``grid`` at latitude ``lat``."""
    r = S.WGS84_A_M / 1000.0
    base = r * r * math.radians(grid.dx) * math.radians(grid.dy)
    return F.lit(base) * F.cos(F.radians(lat))
