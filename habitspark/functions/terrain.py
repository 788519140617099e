"""Slope, aspect and orientation from a 3x3 elevation window."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from habitspark import settings as S


def gradients(z: dict[tuple[int, int], Column], lat: Column, dx_deg: float, dy_deg: float):
    """Third-order finite differences in metres; ``z`` maps (drow, dcol) to elevation.

    A missing neighbour takes the centre value, a missing centre gives null.
    """
    centre = z[(0, 0)]
    v = {k: F.coalesce(c, centre) for k, c in z.items()}
    cell_x = F.lit(dx_deg * S.METRES_PER_DEGREE) * F.cos(F.radians(lat))
    cell_x = F.when(F.abs(cell_x) >= F.lit(1.0), cell_x)
    cell_y = F.lit(dy_deg * S.METRES_PER_DEGREE)
    east = v[(-1, 1)] + F.lit(2.0) * v[(0, 1)] + v[(1, 1)]
    west = v[(-1, -1)] + F.lit(2.0) * v[(0, -1)] + v[(1, -1)]
    south = v[(1, -1)] + F.lit(2.0) * v[(1, 0)] + v[(1, 1)]
    north = v[(-1, -1)] + F.lit(2.0) * v[(-1, 0)] + v[(-1, 1)]
    return (east - west) / (F.lit(8.0) * cell_x), (south - north) / (F.lit(8.0) * cell_y)


def slope_deg(gx: Column, gy: Column) -> Column:
    return F.degrees(F.atan(F.sqrt(gx * gx + gy * gy)))


def aspect_deg(gx: Column, gy: Column) -> Column:
    """Clockwise from north, null on flat ground."""
    angle = F.degrees(F.atan2(gy, -gx))
    bearing = F.when(angle > F.lit(90.0), F.lit(450.0) - angle).otherwise(F.lit(90.0) - angle)
    return F.when((gx != 0) | (gy != 0), bearing)


def northness(aspect: Column, lat: Column | None = None) -> Column:
    """Cosine of the aspect, zero on flat ground; with ``lat`` positive means the warm side."""
    value = F.coalesce(F.cos(F.radians(aspect)), F.lit(0.0))
    if lat is None:
        return value
    return value * F.when(lat < 0, F.lit(-1.0)).otherwise(F.lit(1.0))


def eastness(aspect: Column) -> Column:
    return F.coalesce(F.sin(F.radians(aspect)), F.lit(0.0))
