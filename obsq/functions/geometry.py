"""Distances, tapers, cells and polygons. Polygons and hulls are small and live on the driver; rows stay where they are."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
Point = tuple[float, float]


def haversine_km(lon1: Column, lat1: Column, lon2, lat2) -> Column:
    lon2, lat2 = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lon2, lat2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # least() would pass over a null, and so put places that are null at the far end of the earth.
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def in_circle(lon: Column, lat: Column, centre: Point, radius_km: float) -> Column:
    """1 inside, 0 outside."""
    return F.when(haversine_km(lon, lat, *centre) <= radius_km, 1).otherwise(0)


def gaspari_cohn(distance: Column, length: float) -> Column:
    """The fifth-order taper that falls to 0 at `length` (Gaspari and Cohn 1999); 1 at distance 0."""
    z = distance / (length / 2.0)
    near = -F.pow(z, 5) / 4 + F.pow(z, 4) / 2 + F.pow(z, 3) * 5 / 8 - F.pow(z, 2) * 5 / 3 + 1
    far = F.pow(z, 5) / 12 - F.pow(z, 4) / 2 + F.pow(z, 3) * 5 / 8 + F.pow(z, 2) * 5 / 3 - 5 * z + 4 - F.lit(2.0) / (3 * z)
    return F.when(z <= 1, near).when(z <= 2, far).otherwise(0.0)


def in_polygon(x: Column, y: Column, corners: Sequence[Point]) -> Column:
    """Whether a ray to the right crosses the ring an odd number of times, after a test against its box.

    The ring becomes one array of edges that the rows are folded over, so the expression doesn't grow with it.
    """
    ring = [*corners]
    if len(ring) < 3:
        raise ValueError("a polygon has at least three corners")
    xs, ys = zip(*ring)
    edges = [(x1, y1, x2, y2) for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]) if y1 != y2]
    table = F.array(*(F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), e))) for e in edges))
    crossed = F.size(F.filter(table, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])))
    box = x.between(min(xs), max(xs)) & y.between(min(ys), max(ys))
    return F.coalesce(F.when(box, crossed % 2 == 1).otherwise(False), F.lit(False))


def shrink(corners: Sequence[Point], factor: float) -> list[Point]:
    """Corners moved towards their mean by a part of the way."""
    cx, cy = (sum(v) / len(corners) for v in zip(*corners))
    return [(x - factor * (x - cx), y - factor * (y - cy)) for x, y in corners]


def triangles(points: np.ndarray) -> list[tuple[int, int, int]]:
    """Delaunay triangles of a small set of points, by adding them one at a time (Bowyer 1981, Watson 1981)."""
    n = len(points)
    centre, size = points.mean(0), max(np.ptp(points, axis=0).max(), 1e-9) * 50
    p = np.vstack((points, centre + np.array([[-size, -size], [size, -size], [0, size]])))
    found = {(n, n + 1, n + 2)}

    def circle(t):
        (ax, ay), (bx, by), (cx, cy) = p[list(t)]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        if d == 0:
            return (0.0, 0.0, math.inf)
        ux = ((ax**2 + ay**2) * (by - cy) + (bx**2 + by**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by)) / d
        uy = ((ax**2 + ay**2) * (cx - bx) + (bx**2 + by**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)) / d
        return (ux, uy, (ax - ux) ** 2 + (ay - uy) ** 2)

    circles = {t: circle(t) for t in found}
    for i in range(n):
        bad = [t for t in found if (p[i, 0] - circles[t][0]) ** 2 + (p[i, 1] - circles[t][1]) ** 2 < circles[t][2]]
        sides: dict[tuple[int, int], int] = {}
        for a, b, c in bad:
            for s in ((a, b), (b, c), (a, c)):
                sides[tuple(sorted(s))] = sides.get(tuple(sorted(s)), 0) + 1
        found.difference_update(bad)
        for (a, b), k in sides.items():
            if k == 1:
                t = tuple(sorted((a, b, i)))
                found.add(t)
                circles[t] = circle(t)
    return sorted(t for t in found if max(t) < n)


def concave_hull(points: Sequence[Point], alpha: float) -> list[list[Point]]:
    """Rings around the triangles whose circumscribed circle has a radius under alpha."""
    p = np.asarray(points, float)
    count: dict[tuple[int, int], int] = {}
    for t in triangles(p):
        a, b, c = (math.dist(p[i], p[j]) for i, j in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])))
        s = (a + b + c) / 2
        area = math.sqrt(max(s * (s - a) * (s - b) * (s - c), 0.0))
        if area and a * b * c / (4 * area) < alpha:
            for e in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])):
                count[e] = count.get(e, 0) + 1
    return [[tuple(p[i]) for i in ring] for ring in rings(e for e, k in count.items() if k == 1)]


def rings(edges) -> list[list[int]]:
    """Closed rings of the corners that edges join, each from its smallest corner."""
    beside: dict[int, list[int]] = {}
    for a, b in edges:
        beside.setdefault(a, []).append(b)
        beside.setdefault(b, []).append(a)
    out = []
    while any(beside.values()):
        first = at = min(k for k, v in beside.items() if v)
        ring = []
        while True:
            ring.append(at)
            to = beside[at].pop()
            beside[to].remove(at)
            at = to
            if at == first or not beside[at]:
                break
        out.append(ring)
    return out


def cell_id(lon: Column, lat: Column, mesh_km: float) -> Column:
    """A cell of a reduced grid: bands of latitude, each cut into as many cells as its circle is long."""
    step = 180.0 * mesh_km / (math.pi * EARTH_KM)
    band = F.floor((lat + 90.0) / step)
    middle = (band + 0.5) * step - 90.0
    cells = F.greatest(F.floor(F.cos(F.radians(middle)) * 360.0 / step), F.lit(1))
    return (band * 1_000_000 + F.least(F.floor(F.pmod(lon, F.lit(360.0)) / (F.lit(360.0) / cells)), cells - 1)).cast("long")


def cell_centre(lon: Column, lat: Column, mesh_km: float) -> tuple[Column, Column]:
    """Longitude and latitude of the centre of the cell that holds a place."""
    step = 180.0 * mesh_km / (math.pi * EARTH_KM)
    band = F.floor((lat + 90.0) / step)
    middle = (band + 0.5) * step - 90.0
    cells = F.greatest(F.floor(F.cos(F.radians(middle)) * 360.0 / step), F.lit(1))
    k = F.least(F.floor(F.pmod(lon, F.lit(360.0)) / (F.lit(360.0) / cells)), cells - 1)
    return (k + 0.5) * 360.0 / cells, middle
