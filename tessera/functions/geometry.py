"""Rings as arrays of points: Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rings(vertices: DataFrame, key: str = "cell_id") -> DataFrame:
    """(key, ring array<struct<x,y>>, xmin, ymin, xmax, ymax): one open ring per key in vertex order."""
    points = F.transform(F.array_sort(F.collect_list(F.struct("vertex_idx", "x", "y"))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    return vertices.groupBy(key).agg(points.alias("ring"), F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))


def edges(ring: Column) -> Column:
    """Array of (x1, y1, x2, y2), the last closing the ring."""
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, nxt, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def _sum(array: Column, f) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, e: s + f(e))


def signed_area(ring: Column) -> Column:
    return _sum(edges(ring), lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"]) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def perimeter(ring: Column) -> Column:
    return _sum(edges(ring), lambda e: F.sqrt(F.pow(e["x2"] - e["x1"], 2) + F.pow(e["y2"] - e["y1"], 2)))


def centroid(ring: Column) -> Column:
    """struct<x,y>; the vertex mean where the area is 0."""
    a = signed_area(ring)
    cross = lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"]
    cx = _sum(edges(ring), lambda e: (e["x1"] + e["x2"]) * cross(e)) / (6 * a)
    cy = _sum(edges(ring), lambda e: (e["y1"] + e["y2"]) * cross(e)) / (6 * a)
    flat = a == 0
    return F.struct(F.when(flat, _sum(ring, lambda p: p["x"]) / F.size(ring)).otherwise(cx).alias("x"), F.when(flat, _sum(ring, lambda p: p["y"]) / F.size(ring)).otherwise(cy).alias("y"))


def scale(ring: Column, factor: float, centre: Column | None = None) -> Column:
    """Affine about the centroid."""
    c = centroid(ring) if centre is None else centre
    return F.transform(ring, lambda p: F.struct((c["x"] + (p["x"] - c["x"]) * factor).alias("x"), (c["y"] + (p["y"] - c["y"]) * factor).alias("y")))


def valid_scaled(ring: Column, factor: float) -> Column:
    """The ring scaled about its centroid; null for fewer than three corners or no area."""
    return F.when((F.size(ring) >= 3) & (area(ring) > 0), scale(ring, factor))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting: an odd number of edges to the right.  Half-open on the outline itself."""
    return crosses(edges(ring), x, y)


def crosses(edge_list: Column, x: Column, y: Column) -> Column:
    """Whether the ray from a point to the right meets an odd number of edges."""
    crossings = F.aggregate(edge_list, F.lit(0), lambda n, e: n + F.when(((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]), 1).otherwise(0))
    return crossings % 2 == 1


def on_outline(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies on an edge, to exclude the outline."""
    return F.exists(edges(ring), lambda e: ((e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"])) & (x >= F.least(e["x1"], e["x2"])) & (x <= F.greatest(e["x1"], e["x2"])) & (y >= F.least(e["y1"], e["y2"])) & (y <= F.greatest(e["y1"], e["y2"])))


def pad(ring: Column, n: int) -> Column:
    """Exactly n vertices: cut, or filled with the first."""
    return F.slice(F.concat(ring, F.array_repeat(F.element_at(ring, 1), n)), 1, n)


def sample(ring: Column, n: int = 16) -> Column:
    """At most n vertices, evenly spaced by index."""
    picked = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(ring, (F.floor(i * (F.size(ring) - 1) / (n - 1)) + 1).cast("int")))
    return F.when(F.size(ring) <= n, ring).otherwise(picked)


def angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees between two vectors; null if one has no length."""
    n = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
    return F.when(n > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / n)))))


def largest(ring_list: Column) -> Column:
    """The ring of most area of a list."""
    return F.element_at(F.array_sort(F.transform(ring_list, lambda r: F.struct((-area(r)).alias("a"), r.alias("ring")))), 1)["ring"]


def fov_to_global(x_local: Column, y_local: Column, x_mm: Column, y_mm: Column, mm_per_px: float = 0.12028e-3, height: int = 4256) -> tuple[Column, Column]:
    """Pixel of a field of view to global pixels: offset by the field's place, y turned."""
    return x_local + x_mm / mm_per_px, (height - y_local) + y_mm / mm_per_px


def z_level(mean_z: Column) -> Column:
    return (F.floor(mean_z / 3) * 3).cast("long")
