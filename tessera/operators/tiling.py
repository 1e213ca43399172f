"""Tiles: rectangular, sliding, balanced, and recursive regions; splits and samples by hash."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import tile_uid
from .ranks import quantiles


def check_tile_arguments(size: float | None, width: float | None, height: float | None) -> None:
    """Either a size or width and height."""
    if (size is None) == (width is None and height is None) or (size is None and (width is None or height is None)):
        raise ValueError("give either a tile size or width and height")


def rectangular(points: DataFrame, box: DataFrame, width: float, height: float) -> DataFrame:
    """Points with their tile's corner (tx, ty), size clipped at the box's end, and tile_id.  ``box``: one row of extents."""
    p = points.crossJoin(F.broadcast(box))  # one row
    i = F.least(F.floor((F.col("x") - F.col("xmin")) / width), F.greatest(F.ceil((F.col("xmax") - F.col("xmin")) / width) - 1, F.lit(0)))
    j = F.least(F.floor((F.col("y") - F.col("ymin")) / height), F.greatest(F.ceil((F.col("ymax") - F.col("ymin")) / height) - 1, F.lit(0)))
    p = p.withColumn("tx", F.col("xmin") + i * width).withColumn("ty", F.col("ymin") + j * height)
    p = p.withColumn("tw", F.least(F.lit(float(width)), F.col("xmax") - F.col("tx"))).withColumn("th", F.least(F.lit(float(height)), F.col("ymax") - F.col("ty")))
    return p.withColumn("tile_id", tile_uid(F.col("tx"), F.col("ty"), F.col("tw"), F.col("th"))).drop("xmin", "ymin", "xmax", "ymax")


def sliding(points: DataFrame, x0: float, y0: float, step: float, size: float, margin: float = 0.0) -> DataFrame:
    """One row per point and window (i, j) that holds it: [x0 + i step - margin, x0 + i step + size + margin), likewise y, i and j from 0."""

    def windows(c: str, origin: float) -> Column:
        v = F.col(c) - origin
        low = F.greatest(F.lit(0), (F.floor((v - size - margin) / step) + 1).cast("long"))
        high = F.floor((v + margin) / step).cast("long")
        return F.when(high >= low, F.sequence(low, high))

    return points.withColumn("i", F.explode(windows("x", x0))).withColumn("j", F.explode(windows("y", y0)))


Box = tuple[float, float, float, float]
INF = float("inf")
#: Points of a box up to which its quantiles come from one group of an aggregate.
GROUP = 200_000


def _cuts(points: DataFrame, boxes: list[Box], shares: list[float]) -> list[tuple[int, int, str, float, float]]:
    """Per box with points: its number, count, longest side, the exact quantile of its share there, and that side's end.

    One pass counts all boxes of a level; small boxes share an aggregate, large ones are
    refined by histograms, so no task holds the coordinates of a large box.
    """
    tagged = tag(points.select("x", "y"), boxes, "node")
    stats = tagged.groupBy("node").agg(F.count("*").alias("n"), F.min("x").alias("lx"), F.max("x").alias("hx"), F.min("y").alias("ly"), F.max("y").alias("hy")).collect()  # one row per box
    small = points.sparkSession.createDataFrame([(r.node,) for r in stats if r.n <= GROUP], "node int")
    every = sorted(set(shares))
    at = {}
    if any(r.n <= GROUP for r in stats):
        q = tagged.join(F.broadcast(small), "node").groupBy("node").agg(*(F.percentile(c, F.array(*map(F.lit, every))).alias(c) for c in ("x", "y")))
        at = {r.node: r for r in q.collect()}
    out = []
    for r in sorted(stats):
        axis = "x" if r.hx - r.lx >= r.hy - r.ly else "y"
        if r.node in at:
            q = at[r.node][axis][every.index(shares[r.node])]
        else:
            (q,) = quantiles(points.where(_inside(boxes[r.node])), axis, [shares[r.node]])
        out.append((r.node, r.n, axis, q, r[f"h{axis}"]))
    return out


def _inside(box: Box) -> Column:
    return (F.col("x") > box[0]) & (F.col("x") <= box[2]) & (F.col("y") > box[1]) & (F.col("y") <= box[3])


def _halves(box: Box, axis: str, q: float) -> tuple[Box, Box]:
    x0, y0, x1, y1 = box
    return ((x0, y0, q, y1), (q, y0, x1, y1)) if axis == "x" else ((x0, y0, x1, q), (x0, q, x1, y1))


def regions(points: DataFrame, n: int) -> list[Box]:
    """n boxes of about as many points each: the longest side is cut at the quantile of the share that goes left (at or below the cut)."""
    done, level = [], [((-INF, -INF, INF, INF), n)]
    while level:
        done += [box for box, k in level if k == 1]
        cut = [(box, k) for box, k in level if k > 1]
        level = []
        for node, _, axis, q, _ in _cuts(points, [box for box, _ in cut], [(k // 2) / k for _, k in cut]) if cut else ():
            box, k = cut[node]
            low, high = _halves(box, axis, q)
            level += [(low, k // 2), (high, k - k // 2)]
    return sorted(done)


def balanced(points: DataFrame, max_size: int, leaf: int = 100) -> list[Box]:
    """Boxes of at most ``max_size`` points: the widest side is cut at the median until they fit.  The boxes go to the driver, the points never."""
    if max_size < leaf:
        raise ValueError("a tile can't be smaller than a leaf")
    done, level = [], [(-INF, -INF, INF, INF)]
    while level:
        boxes, level = level, []
        for node, n, axis, q, high in _cuts(points, boxes, [0.5] * len(boxes)):
            if n <= max_size or q >= high:  # all at one place can't be cut
                done.append(boxes[node])
            else:
                level += _halves(boxes[node], axis, q)
    return sorted(done)


def tag(points: DataFrame, boxes: list[Box], column: str = "tile") -> DataFrame:
    """Points with the number of the half-open box (low, high] that holds them: an equi-join on grid cells that a few boxes meet each."""
    side = 2 * math.ceil(len(boxes) ** 0.5)
    edges = [sorted({v for b in boxes for v in (b[k], b[k + 2]) if abs(v) < INF}) for k in (0, 1)]
    low = [e[0] if e else 0.0 for e in edges]
    step = [max((e[-1] - e[0]) / side, 1e-300) if e else 1.0 for e in edges]

    def cell(v: float, k: int) -> int:
        return (0 if v < 0 else side - 1) if abs(v) == INF else max(0, min(side - 1, math.floor((v - low[k]) / step[k])))

    rows = [(i, j, k, *map(float, b)) for k, b in enumerate(boxes) for i in range(cell(b[0], 0), cell(b[2], 0) + 1) for j in range(cell(b[1], 1), cell(b[3], 1) + 1)]
    table = points.sparkSession.createDataFrame(rows, f"bi int, bj int, {column} int, bx0 double, by0 double, bx1 double, by1 double")
    at = lambda c, k: F.greatest(F.lit(0), F.least(F.lit(side - 1), F.floor((F.col(c) - F.lit(low[k])) / F.lit(step[k])))).cast("int")
    out = points.withColumn("bi", at("x", 0)).withColumn("bj", at("y", 1)).join(F.broadcast(table), ["bi", "bj"])  # some four rows per box, which the driver made
    return out.where((F.col("x") > F.col("bx0")) & (F.col("x") <= F.col("bx1")) & (F.col("y") > F.col("by0")) & (F.col("y") <= F.col("by1"))).drop("bi", "bj", "bx0", "by0", "bx1", "by1")


def hash_share(key: Column) -> Column:
    """A number in [0, 1000) from a key: the same in any engine."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % 1000


def assign_split(tiles: DataFrame, train: float = 0.7, val: float = 0.2, column: str = "tile_id") -> DataFrame:
    """split of each tile by hash; tiles without a positive edge (has_edges false) only test."""
    h = hash_share(F.col(column))
    split = F.when(h < round(train * 1000), "train").when(h < round((train + val) * 1000), "val").otherwise("test")
    if "has_edges" in tiles.columns:
        split = F.when(~F.col("has_edges"), "test").otherwise(split)
    return tiles.withColumn("split", split)


def sample_tiles(tiles: DataFrame, frac: float, column: str = "tile_id") -> DataFrame:
    """int(n * frac) tiles, the first by hash.  The tile table is small: one row per tile."""
    if not 0 < frac <= 1:
        raise ValueError("a fraction is above 0 and at most 1")
    n = int(tiles.count() * frac)
    if not n:
        raise ValueError("no tile is left")
    return tiles.orderBy(F.md5(F.col(column).cast("string")), column).limit(n)
