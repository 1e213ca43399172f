"""Spatial joins as equi-joins on grid cells: never a cross join, skew left to AQE."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import contains, crosses, edges, rings
from .knn import knn


def _cell(c: str, size: float) -> Column:
    return F.floor(F.col(c) / F.lit(float(size))).cast("long")


def _square(dims: tuple[str, ...]) -> Column:
    terms = [F.pow(F.col(f"a_{d}") - F.col(f"b_{d}"), 2) for d in dims]
    return sum(terms[1:], terms[0])


def pairs_within(left: DataFrame, right: DataFrame, distance: float, dims: tuple[str, ...] = ("x", "y"), closed: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, src, dst, d) of left and right rows (id and coordinates) less than ``distance`` apart, equal in the columns ``by``.

    The grid's cells are as wide as the distance.  Each left row looks into its own
    cell and those around it: 3^dims narrow rows, one shuffle of each side.
    """
    around = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    a = left.select(*by, F.col("id").alias("src"), *(F.col(d).alias(f"a_{d}") for d in dims))
    for d in dims:
        a = a.withColumn(f"o_{d}", F.explode(around)).withColumn(f"c_{d}", _cell(f"a_{d}", distance) + F.col(f"o_{d}")).drop(f"o_{d}")
    b = right.select(*by, F.col("id").alias("dst"), *(F.col(d).alias(f"b_{d}") for d in dims))
    for d in dims:
        b = b.withColumn(f"c_{d}", _cell(f"b_{d}", distance))
    pairs = a.join(b, [*by, *(f"c_{d}" for d in dims)]).select(*by, "src", "dst", F.sqrt(_square(dims)).alias("d"))
    return pairs.where(F.col("d") <= distance if closed else F.col("d") < distance)


def self_pairs(points: DataFrame, distance: float, dims: tuple[str, ...] = ("x", "y"), closed: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, src, dst, d) of a table's own rows, each pair in both directions, a row with itself included.

    A row looks into its own cell and one of each two opposite neighbours, half of what
    ``pairs_within`` sends; the pairs found are turned round.  ``id`` is unique within ``by``.
    """
    forward = [o for o in product((-1, 0, 1), repeat=len(dims)) if o >= (0,) * len(dims)]
    offsets = F.explode(F.array(*(F.struct(*(F.lit(v).alias(d) for v, d in zip(o, dims))) for o in forward)))
    cells = [_cell(d, distance) for d in dims]
    a = points.select(*by, F.col("id").alias("src"), *(F.col(d).alias(f"a_{d}") for d in dims), *(c.alias(f"h_{d}") for c, d in zip(cells, dims)), offsets.alias("o"))
    home = reduce(lambda p, q: p & q, [F.col(f"o.{d}") == 0 for d in dims])
    a = a.select(*by, "src", *(f"a_{d}" for d in dims), *((F.col(f"h_{d}") + F.col(f"o.{d}")).alias(f"c_{d}") for d in dims), home.alias("home"))
    b = points.select(*by, F.col("id").alias("dst"), *(F.col(d).alias(f"b_{d}") for d in dims), *(c.alias(f"c_{d}") for c, d in zip(cells, dims)))
    pairs = a.join(b, [*by, *(f"c_{d}" for d in dims)]).where(~F.col("home") | (F.col("src") <= F.col("dst")))
    pairs = pairs.select(*by, "src", "dst", F.sqrt(_square(dims)).alias("d")).where(F.col("d") <= distance if closed else F.col("d") < distance)
    there = F.struct("src", "dst")
    both = F.when(F.col("src") == F.col("dst"), F.array(there)).otherwise(F.array(there, F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return pairs.select(*by, F.explode(both).alias("p"), "d").select(*by, "p.src", "p.dst", "d")


def knn_join(left: DataFrame, right: DataFrame, k: int, max_distance: float, dims: tuple[str, ...] = ("x", "y"), include_self: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, src, dst, d, rank): up to k nearest, strictly nearer than ``max_distance``; ties by dst.

    Only the k nearest leave a task: pairs within the distance would grow with the square of the density.
    """
    return knn(left, right, k, max_distance, dims, include_self, by)


def self_knn(points: DataFrame, k: int, max_distance: float, dims: tuple[str, ...] = ("x", "y"), include_self: bool = True, by: tuple[str, ...] = (), flag: str | None = None) -> DataFrame:
    """``knn_join`` of a table with itself, for ids that are unique; with the column ``flag``, also its src_flag and dst_flag."""
    return knn(points, None, k, max_distance, dims, include_self, by, flag)


def nearest(points: DataFrame, start: float, dims: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """(id, d): distance to the nearest other point, without a bound: the search radius doubles for those that found none.

    A lone point, which has no other, is left out.
    """
    from ..sources.storage import save

    done, todo, radius = None, points, start
    spans = points.agg(*(F.max(d) - F.min(d) for d in dims)).first()
    widest = sum((s or 0.0) ** 2 for s in spans) ** 0.5
    while True:
        hit = save(pairs_within(todo, points, radius, dims).where("src <> dst").groupBy(F.col("src").alias("id")).agg(F.min("d").alias("d")), "nearest")
        done = hit if done is None else done.unionByName(hit)
        if radius > widest:  # everything was in reach
            return done
        todo = save(todo.join(hit.select("id"), "id", "left_anti"), "nearest-todo")
        if todo.isEmpty():
            return done
        radius *= 2


def radius_graph(points: DataFrame, radius: float) -> DataFrame:
    """(src, dst, d): neighbours at most ``radius`` away, without the point itself."""
    return self_pairs(points, radius, closed=True).where("src <> dst")


def _dealt(vertices: DataFrame) -> DataFrame:
    """Rings in the grid cells that they meet: cell_id, level, gx, gy, edges.

    A ring's level follows from its box, and the cells of a level are an eighth of its
    scale, so every ring meets 289 cells at most.  A cell that no edge's box meets lies
    inside (no edges are kept) or outside (it goes).  Of a cell that an edge's box meets, the
    edges are kept that a ray to the right from one of its points may meet.
    """
    r = rings(vertices).where(F.size("ring") >= 3)
    wide = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"), F.lit(1e-9))
    r = r.withColumn("level", F.floor(F.log2(wide)).cast("int")).withColumn("g", F.pow(F.lit(2.0), F.col("level") - 3))
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / F.col("g")).cast("long"), F.floor(F.col(hi) / F.col("g")).cast("long"))
    r = r.withColumn("gx", F.explode(span("xmin", "xmax"))).withColumn("gy", F.explode(span("ymin", "ymax")))
    x0, y0 = F.col("gx") * F.col("g"), F.col("gy") * F.col("g")
    x1, y1 = x0 + F.col("g"), y0 + F.col("g")
    crossed = F.exists(edges(F.col("ring")), lambda e: (F.least(e["x1"], e["x2"]) <= x1) & (F.greatest(e["x1"], e["x2"]) >= x0) & (F.least(e["y1"], e["y2"]) <= y1) & (F.greatest(e["y1"], e["y2"]) >= y0))
    centre = contains(F.col("ring"), (x0 + x1) / 2, (y0 + y1) / 2)
    r = r.withColumn("crossed", crossed).where(F.col("crossed") | centre)
    ahead = F.filter(edges(F.col("ring")), lambda e: (F.least(e["y1"], e["y2"]) <= y1) & (F.greatest(e["y1"], e["y2"]) >= y0) & (F.greatest(e["x1"], e["x2"]) >= x0))
    return r.select("cell_id", "level", "gx", "gy", F.when(F.col("crossed"), ahead).alias("edges"))


def points_in_rings(points: DataFrame, vertices: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, cell_id): every ring that contains a point, half-open on the outline.

    An equi-join on the grid cells of the rings' levels; edges are only looked at for
    points in cells that an edge meets.
    """
    from ..sources.storage import save

    dealt = save(_dealt(vertices), "rings")
    levels = [r.level for r in dealt.select("level").distinct().collect()]  # one for each doubling of size
    if not levels:
        return points.select("id", *keep, F.lit(None).cast(dict(dealt.dtypes)["cell_id"]).alias("cell_id")).where("false")
    at = lambda c, k: F.floor(F.col(c) / F.lit(2.0 ** (k - 3))).cast("long")
    p = points.select("id", *keep, "x", "y", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), at("x", k).alias("gx"), at("y", k).alias("gy")) for k in sorted(levels)))).alias("g"))
    hit = p.select("id", *keep, "x", "y", "g.*").join(dealt, ["level", "gx", "gy"])
    return hit.where(F.col("edges").isNull() | crosses(F.col("edges"), F.col("x"), F.col("y"))).select("id", *keep, "cell_id")


def first_ring(points: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, cell_id or null, overlaps): the containing ring with the smallest id."""
    hit = points_in_rings(points, vertices).groupBy("id").agg(F.min("cell_id").alias("cell_id"))
    return points.select("id").join(hit, "id", "left").withColumn("overlaps", F.col("cell_id").isNotNull())
