"""Nearest of many points to many places, on the sphere, within one task.

Points and asked places are ordered along a curve that fills their area and cut into runs of ``RUN``: runs of points, runs
of runs and so on form a tree. Each node is a ball around one of its own points, so the distance to that point bounds the nearest
distance from above, and less the radius from below. Blocks of asked places go down the tree together, then each place on its own.
Places amid the points are settled first: a lattice with about ``HELD`` points a square tells the nearest one if it is closer than any
point beyond the eight squares around. Squares of cities are left to the tree.

All bounds are chords, which obey the triangle inequality; the distance itself is the haversine of the points that are nearest
up to rounding.
"""

from __future__ import annotations

import math

import numpy as np

from habitspark import settings as S

RUN = 8
BLOCK = 16  # asked places that go down the tree together
TOP = 64  # nodes that every block starts with
PAIRS = 1_000_000  # pairs looked at together
HELD = 2  # points a square of the lattice has on average
MOST_HELD = 64  # points of nine squares that a place is compared with
SLACK = 1e-12  # of a chord: far more than rounding, six nanometres on the ground


def _on_sphere(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    x, y = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)], axis=1)


def _spread(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


def _curve(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Order along a Z curve over the area of the places, longitudes shrunk as at their mean latitude."""
    width = max(np.ptp(lon) * max(math.cos(math.radians(float(lat.mean()))), 0.01), np.ptp(lat), 1e-12)
    scale = ((1 << 20) - 1) / width
    x = (lon - lon.min()) * max(math.cos(math.radians(float(lat.mean()))), 0.01) * scale
    y = (lat - lat.min()) * scale
    return np.argsort((_spread(y) << np.uint64(1)) | _spread(x), kind="stable")


def _runs(n: int, size: int) -> np.ndarray:
    """Positions by run; the last run repeats its last one."""
    return np.minimum(np.arange(-(-n // size) * size), n - 1).reshape(-1, size)


def _length(v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("...i,...i->...", v, v))


def _above(centre: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Balls around runs of balls, each around the centre nearest to their mean."""
    runs = _runs(len(centre), RUN)
    own = centre[runs]
    first = np.argmin(_length(own - own.mean(axis=1, keepdims=True)), axis=1)
    around = own[np.arange(len(runs)), first]
    return around, (_length(own - around[:, None]) + radius[runs]).max(axis=1)


def _least(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Smallest value of each owner; pairs are ordered by owner."""
    out = np.full(n, np.inf)
    if len(values):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        out[owner[starts]] = np.minimum.reduceat(values, starts)
    return out


def _children(owner: np.ndarray, node: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    below = (node[:, None] * RUN + np.arange(RUN)).ravel()
    owners = np.repeat(owner, RUN)
    real = below < n
    return owners[real], below[real]


def _haversine(lon: np.ndarray, lat: np.ndarray, other_lon: np.ndarray, other_lat: np.ndarray) -> np.ndarray:
    h = np.sin(np.radians(other_lat - lat) / 2) ** 2 + np.cos(np.radians(lat)) * np.cos(np.radians(other_lat)) * np.sin(np.radians(other_lon - lon) / 2) ** 2
    return 2 * S.EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def _amid(points: np.ndarray, lon: np.ndarray, lat: np.ndarray, asked_lon: np.ndarray, asked_lat: np.ndarray) -> np.ndarray:
    """Distances of the places that their own and the eight squares around settle; infinite for the others."""
    out = np.full(len(asked_lon), np.inf)
    if max(lon.max(), asked_lon.max()) - min(lon.min(), asked_lon.min()) >= 180.0:
        return out  # a difference of longitudes would say nothing of the distance
    west, south = lon.min(), lat.min()
    width, height = np.ptp(lon), np.ptp(lat)
    step = max(math.sqrt(width * height * HELD / len(lon)), max(width, height) * HELD / len(lon), 1e-6)
    if step > 1.0:
        return out  # few points far apart
    nx, ny = int(width / step) + 1, int(height / step) + 1
    square = ((lat - south) / step).astype(np.int64) * nx + ((lon - west) / step).astype(np.int64)
    order = np.argsort(square, kind="stable")
    starts = np.r_[0, np.cumsum(np.bincount(square, minlength=nx * ny))]
    x, y = np.floor((asked_lon - west) / step).astype(np.int64), np.floor((asked_lat - south) / step).astype(np.int64)
    near = np.flatnonzero((x >= -1) & (x <= nx) & (y >= -1) & (y <= ny))
    if not len(near):
        return out
    first, last = np.clip(x[near] - 1, 0, nx - 1), np.clip(x[near] + 1, 0, nx - 1)
    rows = y[near, None] + np.array([-1, 0, 1])
    real = (rows >= 0) & (rows < ny)
    rows = np.clip(rows, 0, ny - 1) * nx
    begin, end = starts[rows + first[:, None]], starts[rows + last[:, None] + 1]
    counts = np.where(real, end - begin, 0)
    few = counts.sum(axis=1) <= MOST_HELD
    near, begin, counts = near[few], begin[few], counts[few]
    for at in range(0, len(near), PAIRS // MOST_HELD):
        some = slice(at, at + PAIRS // MOST_HELD)
        own, c = near[some], counts[some].ravel()
        place = np.repeat(np.arange(len(own)), counts[some].sum(axis=1))
        node = order[np.arange(len(place)) + np.repeat(begin[some].ravel() - (np.cumsum(c) - c), c)]
        away = _length(_on_sphere(asked_lon[own], asked_lat[own])[place] - points[node])
        kept = away <= _least(away, place, len(own))[place] + SLACK
        place, node = place[kept], node[kept]
        km = _least(_haversine(lon[node], lat[node], asked_lon[own][place], asked_lat[own][place]), place, len(own))
        # other points lie a step off in latitude or in longitude; a meter less than that, so that rounding does not matter
        free = S.EARTH_KM * np.arcsin(np.cos(np.radians(asked_lat[own])) * math.sin(math.radians(step))) - 0.001
        out[own] = np.where(km <= free, km, np.inf)
    return out


def nearest_km(lon: np.ndarray, lat: np.ndarray, asked_lon: np.ndarray, asked_lat: np.ndarray, radius_km: float = math.inf) -> np.ndarray:
    """Distance of each asked place to the nearest point; infinite if that is beyond the radius (some are given beyond it too)."""
    out = np.full(len(asked_lon), np.inf)
    if not len(lon) or not len(out):
        return out
    points = _on_sphere(lon, lat)
    out = _amid(points, lon, lat, asked_lon, asked_lat)
    rest = np.flatnonzero(np.isinf(out))
    if not len(rest):
        return out
    order = _curve(lon, lat)
    lon, lat, points = lon[order], lat[order], points[order]
    levels = [(points, np.zeros(len(points)))]
    while len(levels[-1][0]) > TOP:
        levels.append(_above(*levels[-1]))
    reach = 2 * math.sin(min(radius_km / S.EARTH_KM, math.pi) / 2) + 1e-9
    rest = rest[_curve(asked_lon[rest], asked_lat[rest])]
    asked_lon, asked_lat = asked_lon[rest], asked_lat[rest]
    asked = _on_sphere(asked_lon, asked_lat)
    own = asked[_runs(len(asked), BLOCK)]
    middle = own.mean(axis=1)
    wide = _length(own - middle[:, None]).max(axis=1)
    at_once = max(1, PAIRS // 1024)  # a block looks at some hundred leaves
    for first in range(0, len(own), at_once):
        some, places = slice(first, first + at_once), slice(first * BLOCK, (first + at_once) * BLOCK)
        out[rest[places]] = _of_blocks(levels, middle[some], wide[some], asked[places], reach, lon, lat, asked_lon[places], asked_lat[places])
    return out


def _of_blocks(levels, middle, wide, asked, reach, lon, lat, asked_lon, asked_lat) -> np.ndarray:
    top = len(levels) - 1
    n = len(middle)
    owner, node = np.repeat(np.arange(n), len(levels[top][0])), np.tile(np.arange(len(levels[top][0])), n)
    for level in range(top, 0, -1):
        centre, radius = levels[level]
        away = _length(middle[owner] - centre[node])
        limit = np.minimum(_least(away, owner, n) + wide, reach)
        kept = away - radius[node] - wide[owner] <= limit[owner] + SLACK
        owner, node = owner[kept], node[kept]
        if level > 1:
            owner, node = _children(owner, node, len(levels[level - 1][0]))
    out = np.full(len(asked), np.inf)
    # the pairs of a block once for each of its places, a bounded number at a time
    counts = np.bincount(owner, minlength=n)
    ends = np.cumsum(counts)
    first = 0
    while first < n:
        base = ends[first] - counts[first]
        last = max(first + 1, int(np.searchsorted(ends, base + max(1, PAIRS // BLOCK), side="right")))
        pairs = slice(base, ends[last - 1])
        places = slice(first * BLOCK, min(last * BLOCK, len(asked)))
        out[places] = _of_places(levels, owner[pairs] - first, node[pairs], counts[first:last], asked[places], reach, lon, lat, asked_lon[places], asked_lat[places])
        first = last
    return out


def _of_places(levels, owner, node, counts, asked, reach, lon, lat, asked_lon, asked_lat) -> np.ndarray:
    n = len(asked)
    starts = np.cumsum(counts) - counts
    block = np.arange(n) // BLOCK
    each = counts[block]
    place = np.repeat(np.arange(n), each)
    if not len(place):
        return np.full(n, np.inf)
    node = node[np.arange(len(place)) - np.repeat(np.cumsum(each) - each, each) + starts[block][place]]
    if len(levels) > 1:
        centre, radius = levels[1]
        away = _length(asked[place] - centre[node])
        limit = np.minimum(_least(away, place, n), reach)
        kept = away - radius[node] <= limit[place] + SLACK
        place, node = _children(place[kept], node[kept], len(levels[0][0]))
    away = _length(asked[place] - levels[0][0][node])
    kept = away <= np.minimum(_least(away, place, n), reach)[place] + SLACK
    place, node = place[kept], node[kept]
    return _least(_haversine(lon[node], lat[node], asked_lon[place], asked_lat[place]), place, n)
