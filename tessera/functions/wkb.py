"""WKB polygons to and from vertex rows."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame


def exterior(data: bytes) -> list[tuple[float, float]]:
    """The exterior ring of a WKB polygon, open; other geometry types raise ValueError."""
    order = "<" if data[0] == 1 else ">"
    (kind,) = struct.unpack_from(order + "I", data, 1)
    at, dims = 5, 2
    if kind & 0x20000000:
        at += 4
    dims += bool(kind & 0x80000000) + bool(kind & 0x40000000) + (1 if 1000 < kind % 10000 < 3000 else 2 if 3000 < kind % 10000 < 4000 else 0)
    if kind & 0xFF != 3 and kind % 1000 != 3:
        raise ValueError("not a polygon")
    n_rings, n = struct.unpack_from(order + "II", data, at)
    if not n_rings:
        return []
    values = struct.unpack_from(f"{order}{n * dims}d", data, at + 8)
    points = [(values[i], values[i + 1]) for i in range(0, n * dims, dims)]
    return points[:-1] if len(points) > 1 and points[0] == points[-1] else points


def polygon(points: list[tuple[float, float]]) -> bytes:
    closed = [*points, points[0]] if points else []
    return struct.pack("<BIII", 1, 3, 1 if points else 0, len(closed)) + b"".join(struct.pack("<dd", *p) for p in closed) if points else struct.pack("<BII", 1, 3, 0)


def explode_wkb(df: DataFrame) -> DataFrame:
    """(cell_id, geometry) -> cell_id, vertex_idx, x, y."""

    def run(it):
        import pandas as pd

        for pdf in it:
            rows = [(c, i, *p) for c, g in zip(pdf["cell_id"], pdf["geometry"]) if g is not None for i, p in enumerate(exterior(bytes(g)))]
            yield pd.DataFrame(rows, columns=["cell_id", "vertex_idx", "x", "y"])

    return df.mapInPandas(run, "cell_id string, vertex_idx long, x double, y double")
