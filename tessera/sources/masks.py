"""Label masks of fields of view: CSV points and outlines traced from mask images."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_field_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of a CSV with a header row, types inferred."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def trace(mask: np.ndarray, label: int) -> np.ndarray:
    """Corners (x, y) of the longest outline of a label, in pixel edges, without collinear ones."""
    inside = np.pad(mask == label, 1)
    follow: dict[tuple[int, int], list[tuple[int, int]]] = {}
    # directed pixel edges with the label on their left hand; each corner leads on to one or two
    for dy, dx, (ax, ay), (bx, by) in ((-1, 0, (1, 0), (0, 0)), (1, 0, (0, 1), (1, 1)), (0, -1, (0, 0), (0, 1)), (0, 1, (1, 1), (1, 0))):
        edge = inside & ~np.roll(inside, (-dy, -dx), (0, 1))
        for y, x in zip(*(k - 1 for k in np.nonzero(edge))):
            follow.setdefault((int(x) + ax, int(y) + ay), []).append((int(x) + bx, int(y) + by))
    best: list[tuple[int, int]] = []
    while follow:
        start = at = next(iter(follow))
        ring = []
        while at in follow:
            ring.append(at)
            to = follow[at].pop()
            if not follow[at]:
                del follow[at]
            at = to
            if at == start:
                break
        if len(ring) > len(best):
            best = ring
    p = np.array(best, float).reshape(-1, 2)
    if len(p) < 3:
        return p
    a, b = p - np.roll(p, 1, axis=0), np.roll(p, -1, axis=0) - p
    return p[a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0] != 0]


def simplify(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on a closed ring, from its first corner and the one furthest from it."""
    if len(ring) < 4:
        return ring
    far = int(np.argmax(((ring - ring[0]) ** 2).sum(1)))
    closed = np.vstack([ring, ring[:1]])
    keep, todo = {0, far, len(ring)}, [(0, far), (far, len(ring))]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        line, between = closed[b] - closed[a], closed[a + 1 : b] - closed[a]
        length = np.hypot(*line)
        away = np.abs(line[0] * between[:, 1] - line[1] * between[:, 0]) / length if length else np.hypot(*between.T)
        k = int(np.argmax(away))
        if away[k] > tolerance:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return closed[sorted(keep - {len(ring)})]


def mask_outlines(masks: DataFrame) -> DataFrame:
    """fov, cell, vertex_idx, x, y: the simplified outline of every label above 0 with more than two corners.

    ``masks``: fov, width, labels (a row-major array of the field's labels).  The tolerance is
    a fiftieth of the mean root area of the field's outlines.  One field is one row of
    bounded size and meets one task.
    """

    def run(it):
        import pandas as pd

        for pdf in it:
            for fov, width, labels in zip(pdf["fov"], pdf["width"], pdf["labels"]):
                mask = np.asarray(labels, np.int64).reshape(-1, int(width))
                found = [(k, trace(mask, int(k))) for k in np.unique(mask) if k > 0]
                found = [(k, r) for k, r in found if len(r) > 2]
                if not found:
                    continue
                size = lambda r: abs(np.dot(r[:, 0], np.roll(r[:, 1], -1)) - np.dot(r[:, 1], np.roll(r[:, 0], -1))) / 2
                tolerance = float(np.mean([size(r) ** 0.5 for _, r in found])) / 50
                for k, r in found:
                    r = simplify(r, tolerance)
                    yield pd.DataFrame({"fov": fov, "cell": int(k), "vertex_idx": np.arange(len(r)), "x": r[:, 0], "y": r[:, 1]})

    return masks.select(F.col("fov").cast("long").alias("fov"), F.col("width").cast("int").alias("width"), "labels").mapInPandas(run, "fov long, cell long, vertex_idx long, x double, y double")
