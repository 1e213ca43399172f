"""Polygon descriptors that need an algorithm: hull, rotated rectangle, bounding circle, concave outline.

One row per cell with its points as an array; numpy in Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, anticlockwise, without collinear points (monotone chain)."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(seq):
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def _area(r: np.ndarray) -> float:
    x, y = r[:, 0], r[:, 1]
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def _perimeter(r: np.ndarray) -> float:
    return float(np.hypot(*(np.roll(r, -1, axis=0) - r).T).sum())


def rotated_rectangle(h: np.ndarray) -> tuple[float, float]:
    """(area, perimeter) of the smallest rectangle round a hull: one side lies on an edge of it."""
    best = (math.inf, 0.0)
    for d in np.roll(h, -1, axis=0) - h:
        n = math.hypot(*d)
        if n:
            u = d / n
            a, b = np.ptp(h @ u), np.ptp(h @ np.array([-u[1], u[0]]))
            best = min(best, (float(a * b), float(2 * (a + b))))
    return best


def bounding_radius(h: np.ndarray) -> float:
    """Radius of the smallest circle that holds all points (incremental, expected linear)."""
    p = h[np.random.default_rng(0).permutation(len(h))]

    def two(a, b):
        c = (a + b) / 2
        return c, math.dist(a, c)

    def three(a, b, c):
        d = 2 * ((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
        if d == 0:
            return max((two(a, b), two(a, c), two(b, c)), key=lambda x: x[1])
        bb, cc = float(np.dot(b - a, b - a)), float(np.dot(c - a, c - a))
        o = a + np.array([(c[1] - a[1]) * bb - (b[1] - a[1]) * cc, (b[0] - a[0]) * cc - (c[0] - a[0]) * bb]) / d
        return o, math.dist(o, a)

    inside = lambda c, q: math.dist(c[0], q) <= c[1] * (1 + 1e-12) + 1e-12
    c = (p[0], 0.0)
    for i in range(1, len(p)):
        if not inside(c, p[i]):
            c = (p[i], 0.0)
            for j in range(i):
                if not inside(c, p[j]):
                    c = two(p[i], p[j])
                    for k in range(j):
                        if not inside(c, p[k]):
                            c = three(p[i], p[j], p[k])
    return c[1]


def _descriptors(it):
    import pandas as pd

    for pdf in it:
        rows = []
        for cell, xs, ys in zip(pdf["cell_id"], pdf["xs"], pdf["ys"]):
            ring = np.column_stack([xs, ys])
            area, h = _area(ring), hull(ring)
            if len(h) < 3 or area == 0:
                rows.append((cell, area, None, None, None, None, None, None))
                continue
            rect, around = rotated_rectangle(h)
            box = float(np.prod(np.ptp(ring, axis=0)))
            rows.append((cell, area, _area(h), _perimeter(h), _area(h) / area, rect / box, around**2 / rect, area / bounding_radius(h) ** 2))
        yield pd.DataFrame(rows, columns=["cell_id", "area", "hull_area", "hull_perimeter", "convexity", "elongation", "elongation_perimeter", "circularity"])


def _arrays(vertices: DataFrame, key: str) -> DataFrame:
    v = vertices.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("vertex_idx", "x", "y"))).alias("v"))
    return v.select(F.col(key).cast("string").alias("cell_id"), F.col("v.x").alias("xs"), F.col("v.y").alias("ys"))


def descriptors(vertices: DataFrame, key: str = "cell_id") -> DataFrame:
    """cell_id, area, hull_area, hull_perimeter, convexity, elongation (two forms), circularity; null where the ring has no area."""
    return _arrays(vertices, key).mapInPandas(_descriptors, "cell_id string, area double, hull_area double, hull_perimeter double, convexity double, elongation double, elongation_perimeter double, circularity double")


def _hull_areas(it):
    import pandas as pd

    for pdf in it:
        areas = [_area(h) if len(h := hull(np.column_stack([x, y]))) > 2 else 0.0 for x, y in zip(pdf["xs"], pdf["ys"])]
        yield pd.DataFrame({"cell_id": pdf["cell_id"], "hull_area": areas})


def _batch_hulls(it):
    import pandas as pd

    for pdf in it:
        code, cells = pd.factorize(pdf["cell_id"])
        order = np.argsort(code, kind="stable")
        xy, first = pdf[["x", "y"]].to_numpy()[order], np.flatnonzero(np.diff(code[order], prepend=-1))
        parts = [p if len(p) < 16 else hull(p) for p in np.split(xy, first[1:])]  # a few points go as they are
        held = np.concatenate(parts) if len(pdf) else xy
        yield pd.DataFrame({"cell_id": np.repeat(np.asarray(cells), [len(p) for p in parts] if len(pdf) else []), "x": held[:, 0], "y": held[:, 1]})


def point_hulls(points: DataFrame) -> DataFrame:
    """(cell_id, hull_area) of each cell's points, 0 for fewer than three or collinear ones.

    Every batch sends only the hulls of its cells, from which the cells' hulls follow.
    """
    p = points.where("cell_id is not null").select("cell_id", "x", "y")
    schema = ", ".join(f"{n} {t}" for n, t in p.dtypes)
    arrays = p.mapInPandas(_batch_hulls, schema).groupBy("cell_id").agg(F.collect_list(F.struct("x", "y")).alias("p"))
    return arrays.select("cell_id", F.col("p.x").alias("xs"), F.col("p.y").alias("ys")).mapInPandas(_hull_areas, f"cell_id {dict(p.dtypes)['cell_id']}, hull_area double")


def delaunay(p: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles of distinct points, by insertion into a large triangle (Bowyer-Watson)."""
    lo, span = p.min(0), float(max(np.ptp(p, axis=0).max(), 1e-9))
    n = len(p)
    q = np.vstack([(p - lo) / span, [[-50, -50], [50, -50], [0, 100]]])
    triangles: dict[tuple[int, int, int], tuple[float, float, float]] = {}

    def circle(t):
        (ax, ay), (bx, by), (cx, cy) = q[list(t)]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        if abs(d) < 1e-14:
            return None
        ux = ((ax * ax + ay * ay) * (by - cy) + (bx * bx + by * by) * (cy - ay) + (cx * cx + cy * cy) * (ay - by)) / d
        uy = ((ax * ax + ay * ay) * (cx - bx) + (bx * bx + by * by) * (ax - cx) + (cx * cx + cy * cy) * (bx - ax)) / d
        return ux, uy, (ax - ux) ** 2 + (ay - uy) ** 2

    triangles[(n, n + 1, n + 2)] = circle((n, n + 1, n + 2))
    for i in np.lexsort((q[:n, 1], q[:n, 0])).tolist():
        x, y = q[i]
        bad = [t for t, (ux, uy, r) in triangles.items() if (x - ux) ** 2 + (y - uy) ** 2 < r * (1 - 1e-12)]
        rim: dict[tuple[int, int], int] = {}
        for t in bad:
            del triangles[t]
            for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                k = (min(e), max(e))
                rim[k] = rim.get(k, 0) + 1
        for (a, b), times in rim.items():
            if times == 1 and (c := circle((a, b, i))) is not None:
                triangles[(a, b, i)] = c
    return [t for t in triangles if max(t) < n]


def concave_outline(points: np.ndarray) -> np.ndarray | None:
    """Outline of a point cloud: its triangulation, with long or flat triangles peeled off from outside.

    d is the greatest distance of a point to its nearest neighbour.  First every outer
    edge longer than 2 d goes; then those longer than 1.5 d opposite an angle above 90
    degrees, or opposite an angle above 168.75 degrees.  Of the outlines left, the one of
    most area.  Null below three points or without triangles.
    """
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return None
    dist = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
    np.fill_diagonal(dist, np.inf)
    d = dist.min(1).max()
    live = set(delaunay(p))
    if not live:
        return None
    owners: dict[tuple[int, int], set] = {}
    for t in live:
        for a, b in ((0, 1), (1, 2), (2, 0)):
            owners.setdefault((min(t[a], t[b]), max(t[a], t[b])), set()).add(t)

    def angle(t, e):
        (c,) = set(t) - set(e)
        u, v = p[e[0]] - p[c], p[e[1]] - p[c]
        n = math.hypot(*u) * math.hypot(*v)
        return math.degrees(math.acos(max(-1.0, min(1.0, float(u @ v) / n)))) if n else 180.0

    def peel(test):
        stack = [e for e, ts in owners.items() if len(ts) == 1]
        while stack:
            e = stack.pop()
            if len(owners.get(e, ())) != 1:
                continue
            (t,) = owners[e]
            if len(live) > 1 and test(dist[e], angle(t, e)):
                live.discard(t)
                for a, b in ((0, 1), (1, 2), (2, 0)):
                    k = (min(t[a], t[b]), max(t[a], t[b]))
                    owners[k].discard(t)
                    if len(owners[k]) == 1:
                        stack.append(k)

    peel(lambda n, a: n > 2 * d)
    peel(lambda n, a: (n > 1.5 * d and a > 90) or a > 168.75)
    nxt: dict[int, list[int]] = {}
    for (a, b), ts in owners.items():
        if len(ts) == 1:
            nxt.setdefault(a, []).append(b)
            nxt.setdefault(b, []).append(a)
    best, seen = None, set()
    for start in sorted(nxt):
        for first in sorted(nxt[start]):
            if (start, first) in seen:
                continue
            ring, prev, at = [start], start, first
            seen.add((start, first))
            while at != start and len(ring) <= len(p) + 1:
                ring.append(at)
                options = [x for x in nxt[at] if x != prev and (at, x) not in seen] or [prev]
                prev, at = at, options[0]
                seen.add((prev, at))
            if len(ring) > 2 and (best is None or _area(p[ring]) > _area(p[best])):
                best = ring
    return None if best is None else p[best]


def _outlines(it):
    import pandas as pd

    for pdf in it:
        rows = []
        for cell, xs, ys in zip(pdf["cell_id"], pdf["xs"], pdf["ys"]):
            r = concave_outline(np.column_stack([xs, ys]).astype(float))
            rows.append((cell, len(xs), None if r is None else [{"x": float(x), "y": float(y)} for x, y in r], None if r is None else _area(r)))
        yield pd.DataFrame(rows, columns=["cell_id", "length", "ring", "area"])


def cell_outlines(points: DataFrame, key: str = "cell_id") -> DataFrame:
    """cell_id, length (points), ring, area of a concave outline per cell; cells are small groups."""
    v = points.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_list("x").alias("xs"), F.collect_list("y").alias("ys"))
    return v.select(F.col(key).cast("string").alias("cell_id"), "xs", "ys").mapInPandas(_outlines, "cell_id string, length long, ring array<struct<x: double, y: double>>, area double")
