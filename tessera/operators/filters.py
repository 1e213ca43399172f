"""Row, tile and cell filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def no_controls(df: DataFrame, prefixes: tuple[str, ...], column: str = "gene") -> DataFrame:
    """Drops labels that start with a prefix, and null labels."""
    if not prefixes:
        return df.where(F.col(column).isNotNull())
    return df.where(~reduce(lambda a, b: a | b, [F.col(column).startswith(p) for p in prefixes]))


def by_quality(df: DataFrame, prefixes: tuple[str, ...] = (), min_qv: float | None = 20, column: str = "qv") -> DataFrame:
    """No controls and qv >= min_qv; where the platform has no quality column (qv is null there) nothing goes for its quality."""
    out = no_controls(df, prefixes) if prefixes else df
    return out.where(F.col(column).isNull() | (F.col(column) >= min_qv)) if min_qv is not None and column in df.columns else out


def in_tile(df: DataFrame, box: tuple[float, float, float, float], margin: float = 0) -> DataFrame:
    """Points of a closed box widened by a margin."""
    x0, y0, x1, y1 = box
    return df.where(F.col("x").between(x0 - margin, x1 + margin) & F.col("y").between(y0 - margin, y1 + margin))


def owned_outlines(vertices: DataFrame, margin: float) -> DataFrame:
    """(tile, cell_id) that a tile owns.

    ``vertices``: tile_id, x0, y0, x3, y3 (tile box), cell_id, x, y of the vertices in the
    tile widened by ``margin``.  Kept: all vertices inside the inner box; or some inside,
    some in the left band and none in the far-y band; or some inside, some in the near-y band and
    none in the right band.
    """
    x1, y1, x4, y4 = F.col("x0") - margin, F.col("y0") - margin, F.col("x3") + margin, F.col("y3") + margin
    xi, yi, xo, yo = F.col("x0") + margin, F.col("y0") + margin, F.col("x3") - margin, F.col("y3") - margin
    x, y = F.col("x"), F.col("y")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    bands = vertices.where(x.between(x1, x4) & y.between(y1, y4)).groupBy("tile_id", "cell_id").agg(
        F.count("*").alias("total"),
        n(x.between(xi, xo) & y.between(yi, yo)).alias("centre"),
        n(x.between(x1, x4) & y.between(y1, yi)).alias("top"),
        n(x.between(x1, xi) & y.between(y1, y4)).alias("left"),
        n(x.between(xo, x4) & y.between(y1, y4)).alias("right"),
        n(x.between(x1, x4) & y.between(yo, y4)).alias("bottom"),
    )
    kept = (F.col("centre") == F.col("total")) | ((F.col("centre") > 0) & (F.col("left") > 0) & (F.col("bottom") == 0)) | ((F.col("centre") > 0) & (F.col("top") > 0) & (F.col("right") == 0))
    return bands.where(kept).select("tile_id", "cell_id")


def viable_tiles(points: DataFrame, outlines: DataFrame, min_points: int = 1000, min_outlines: int = 10) -> DataFrame:
    """tile_id, n_points, n_outlines of tiles with enough of both."""
    p = points.groupBy("tile_id").agg(F.count("*").alias("n_points"))
    o = outlines.groupBy("tile_id").agg(F.countDistinct("cell_id").alias("n_outlines"))
    return p.join(o, "tile_id").where((F.col("n_points") >= min_points) & (F.col("n_outlines") >= min_outlines))


def viable_cells(points: DataFrame, min_points: int = 5, area: tuple[float, float] | None = None) -> DataFrame:
    """cell_id, n of cells with enough points; with ``area`` also hull_area, which lies in that closed window."""
    out = points.where("cell_id is not null").groupBy("cell_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_points)
    if area is None:
        return out
    from .shapes import point_hulls

    return out.join(point_hulls(points), "cell_id").where(F.col("hull_area").between(*area))
