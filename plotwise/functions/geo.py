"""Planar and geographic geometry over arrays of points, as column expressions.

A geometry is ARRAY<ARRAY<ARRAY<STRUCT<x, y>>>>: polygons, each an outer ring and its holes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GEOMETRY = "array<array<array<struct<x:double,y:double>>>>"
#: The ellipsoid's major axis, and the latitude of a ring without points.
EARTH_RADIUS_M, REFERENCE_LAT = 6378137.0, 40.72


def _next(ring: Column, i: Column) -> Column:
    return F.get(ring, F.pmod(i + 1, F.size(ring)))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a ray from the point crosses the ring an odd number of times; left and lower edges are inside."""
    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), _next(ring, i)
        at = (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
        return ((a["y"] > y) != (b["y"] > y)) & F.coalesce(x < at, F.lit(False))

    return F.aggregate(F.sequence(F.lit(0), F.size(ring) - 1), F.lit(False), lambda odd, i: odd != crosses(i))


def in_geometry(x: Column, y: Column, geometry: Column) -> Column:
    """In any polygon's outer ring and in none of its holes."""
    return F.exists(geometry, lambda p: in_ring(x, y, F.get(p, F.lit(0))) & ~F.exists(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(1))), lambda hole: in_ring(x, y, hole)))


def bbox(geometry: Column) -> Column:
    """Struct of min_x, min_y, max_x, max_y over finite vertices; null if there are none."""
    points = F.filter(F.flatten(F.flatten(geometry)), lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    made = F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))
    return F.when(F.size(points) > 0, made)


def ring_area_m2(ring: Column) -> Column:
    """Area by the shoelace after an equirectangular projection at the ring's mean latitude; 0 below three points."""
    n = F.size(ring)
    mean = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["y"], lambda s: s / n)
    scale = F.cos(F.radians(F.coalesce(mean, F.lit(REFERENCE_LAT))))

    def cross(s: Column, i: Column) -> Column:
        a, b = F.get(ring, i), _next(ring, i)
        ax, ay = F.radians(a["x"]) * EARTH_RADIUS_M * scale, F.radians(a["y"]) * EARTH_RADIUS_M
        bx, by = F.radians(b["x"]) * EARTH_RADIUS_M * scale, F.radians(b["y"]) * EARTH_RADIUS_M
        return s + (ax * by - bx * ay)

    return F.when(n < 3, F.lit(0.0)).otherwise(F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), cross)) / 2)


def geometry_area_m2(geometry: Column) -> Column:
    """Outer rings less holes, never below 0 for a polygon, summed."""
    def polygon(p: Column) -> Column:
        holes = F.aggregate(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(1))), F.lit(0.0), lambda s, r: s + ring_area_m2(r))
        return F.greatest(F.lit(0.0), ring_area_m2(F.get(p, F.lit(0))) - holes)

    return F.aggregate(geometry, F.lit(0.0), lambda s, p: s + polygon(p))


def plane_distance(x: Column, y: Column, z: Column, nx: Column, ny: Column, nz: Column, d: Column) -> Column:
    return nx * x + ny * y + nz * z + d


def rotate(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    """Coordinates along axes turned by an angle."""
    return x * F.cos(angle) + y * F.sin(angle), y * F.cos(angle) - x * F.sin(angle)


def project_pinhole(x: Column, y: Column, z: Column, fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column]:
    """Image coordinates of a point in front of a camera; null from z <= 1e-5 on."""
    front = z > 1e-5
    return F.when(front, fx * x / z + cx), F.when(front, fy * y / z + cy)


def triangle_area(a: Column, b: Column, c: Column) -> Column:
    return F.abs((b["x"] - a["x"]) * (c["y"] - a["y"]) - (c["x"] - a["x"]) * (b["y"] - a["y"])) / 2
