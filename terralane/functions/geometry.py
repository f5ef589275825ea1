"""Plane and sphere geometry as column expressions.

Points are x, y columns; lines are tables of straight segments x1, y1, x2, y2 with the length before each segment, m0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
MAP_EARTH_RADIUS_M = 6_371_008.8


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def clamp01(t: Column) -> Column:
    return F.when(t < 0, F.lit(0.0)).when(t > 1, F.lit(1.0)).otherwise(t)


def project(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Share of the segment, 0 to 1, at which it comes nearest to the point."""
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    return F.when(square == 0, F.lit(0.0)).otherwise(clamp01(((px - x1) * dx + (py - y1) * dy) / square))


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    t = project(px, py, x1, y1, x2, y2)
    return distance(px, py, x1 + t * (x2 - x1), y1 + t * (y2 - y1))


def length_in_circle(px: Column, py: Column, r: float, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Length of the segment inside the circle, from the roots of |p1 + t (p2 - p1) - p|^2 = r^2 within [0, 1]."""
    dx, dy, fx, fy = x2 - x1, y2 - y1, x1 - px, y1 - py
    a, b, c = dx * dx + dy * dy, 2 * (fx * dx + fy * dy), fx * fx + fy * fy - r * r
    return chord(a, b, b * b - 4 * a * c)


def chord(a: Column, b: Column, disc: Column) -> Column:
    """Length within [0, 1] between the roots of a t^2 + b t + c, of discriminant ``disc``, on a segment of squared length ``a``."""
    root = F.sqrt(disc)
    within = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.when((a == 0) | (disc <= 0), F.lit(0.0)).otherwise((within((-b + root) / (2 * a)) - within((-b - root) / (2 * a))) * F.sqrt(a))


def crossing(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Struct (x, y) where two segments meet, ends included; for a collinear overlap its middle; null if they don't meet."""
    x1, y1, x2, y2 = a
    x3, y3, x4, y4 = b
    rx, ry, sx, sy, qx, qy = x2 - x1, y2 - y1, x4 - x3, y4 - y3, x3 - x1, y3 - y1
    det = rx * sy - ry * sx
    t, u = (qx * sy - qy * sx) / det, (qx * ry - qy * rx) / det
    proper = F.when(t.between(0, 1) & u.between(0, 1), F.struct((x1 + t * rx).alias("x"), (y1 + t * ry).alias("y")))
    rr = rx * rx + ry * ry
    t0, t1 = (qx * rx + qy * ry) / rr, ((x4 - x1) * rx + (y4 - y1) * ry) / rr
    low, high = F.greatest(F.lit(0.0), F.least(t0, t1)), F.least(F.lit(1.0), F.greatest(t0, t1))
    mid = (low + high) / 2
    overlap = F.when((qx * ry - qy * rx == 0) & (low <= high), F.struct((x1 + mid * rx).alias("x"), (y1 + mid * ry).alias("y")))
    return F.when(det != 0, proper).when(rr > 0, overlap)


def nearest_on_first(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Struct (d, x, y): distance of two segments that don't cross, and the nearest point on the first; ties go to a's start."""
    x1, y1, x2, y2 = a
    x3, y3, x4, y4 = b
    t3, t4 = project(x3, y3, *a), project(x4, y4, *a)
    ends = [
        (segment_distance(x1, y1, *b), x1, y1),
        (segment_distance(x2, y2, *b), x2, y2),
        (distance(x3, y3, x1 + t3 * (x2 - x1), y1 + t3 * (y2 - y1)), x1 + t3 * (x2 - x1), y1 + t3 * (y2 - y1)),
        (distance(x4, y4, x1 + t4 * (x2 - x1), y1 + t4 * (y2 - y1)), x1 + t4 * (x2 - x1), y1 + t4 * (y2 - y1)),
    ]
    return F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i"), x.alias("x"), y.alias("y")) for i, (d, x, y) in enumerate(ends)]))


def fold_angle(a: Column, b: Column) -> Column:
    """Angle between two undirected directions in degrees, 0 to 90."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180.0 - d)


def direction(dx: Column, dy: Column) -> Column:
    """Direction in degrees, 0 to 180; null for no movement."""
    return F.when((dx != 0) | (dy != 0), F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0)))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS_M) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dp, dl = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def inside_ring(px: Column, py: Column, edges: Column) -> Column:
    """Whether a polygon's edges (array of structs x1, y1, x2, y2 of all its rings) cover the point; its border counts."""
    x1, y1, x2, y2 = (lambda e, n=n: e[n] for n in ("x1", "y1", "x2", "y2"))
    on = F.exists(edges, lambda e: segment_distance(px, py, x1(e), y1(e), x2(e), y2(e)) <= 1e-12)
    hits = F.filter(edges, lambda e: ((y1(e) > py) != (y2(e) > py)) & (px < (x2(e) - x1(e)) * (py - y1(e)) / (y2(e) - y1(e)) + x1(e)))
    return on | (F.size(hits) % 2 == 1)


def segments(lines: DataFrame, id_column: str, points: str = "points", part: str = "part") -> DataFrame:
    """Segments of lines given as arrays of structs x, y: id, part, seg, x1, y1, x2, y2, m0, length."""
    pairs = F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(points) - 1, F.lit(1))), lambda i: F.struct(F.get(points, i - 1).alias("p"), F.get(points, i).alias("q"))))
    kept = [id_column] + ([part] if part in lines.columns else [])
    s = lines.where(F.size(points) >= 2).select(*kept, pairs.alias("seg", "e"))
    if part not in lines.columns:
        s = s.withColumn(part, F.lit(0))
    s = s.select(id_column, part, "seg", F.col("e.p.x").alias("x1"), F.col("e.p.y").alias("y1"), F.col("e.q.x").alias("x2"), F.col("e.q.y").alias("y2"))
    s = s.withColumn("length", distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    before = Window.partitionBy(id_column, part).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    return s.withColumn("m0", F.coalesce(F.sum("length").over(before), F.lit(0.0)))


# Transverse Mercator on the WGS84 ellipsoid by Krueger's series to the third order of n.
_A, _FLAT, _K0, _EASTING = 6_378_137.0, 1 / 298.257223563, 0.9996, 500_000.0
_N = _FLAT / (2 - _FLAT)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def to_utm(lon: Column, lat: Column, zone: Column | int) -> tuple[Column, Column]:
    """Easting and northing (north of the equator) in a UTM zone."""
    zone = F.lit(zone) if isinstance(zone, int) else zone
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    e = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return _EASTING + _K0 * _RADIUS * x, _K0 * _RADIUS * y


def from_utm(easting: Column, northing: Column, zone: Column | int) -> tuple[Column, Column]:
    """Longitude and latitude of a point north of the equator in a UTM zone."""
    zone = F.lit(zone) if isinstance(zone, int) else zone
    xi0, eta0 = northing / (_K0 * _RADIUS), (easting - _EASTING) / (_K0 * _RADIUS)
    xi, eta = xi0, eta0
    for j, b in enumerate(_BETA, 1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + (zone * 6 - 183), F.degrees(lat)
