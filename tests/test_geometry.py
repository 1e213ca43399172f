import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry, wkb
from tessera.operators import shapes

SQUARE = [(0, 0), (1, 0), (1, 1), (0, 1)]
CONCAVE = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]


def vertices(spark, **rings):
    rows = [(c, i, float(x), float(y)) for c, r in rings.items() for i, (x, y) in enumerate(r)]
    return spark.createDataFrame(rows, "cell_id string, vertex_idx long, x double, y double")


def test_area_centroid_and_winding(spark):
    v = vertices(spark, a=SQUARE, b=SQUARE[::-1], c=CONCAVE, d=[(100, 100), (200, 100), (300, 100), (400, 100)])
    r = geometry.rings(v).select("cell_id", geometry.area(F.col("ring")).alias("a"), geometry.centroid(F.col("ring")).alias("c"))
    got = {x.cell_id: (x.a, x.c.x, x.c.y) for x in r.collect()}
    assert got["a"] == got["b"] == (1.0, 0.5, 0.5)
    assert got["c"][0] == 10.0
    assert got["d"] == (0.0, 250.0, 100.0)


def test_descriptors(spark):
    got = {x.cell_id: x for x in shapes.descriptors(vertices(spark, a=SQUARE, c=CONCAVE, d=[(0, 0), (1, 0), (2, 0), (3, 0)])).collect()}
    a = got["a"]
    assert (a.hull_area, a.hull_perimeter) == (1.0, 4.0)
    assert a.circularity == pytest.approx(2.0) and a.elongation == pytest.approx(1.0)
    assert got["c"].hull_area == 16 and got["c"].convexity == pytest.approx(1.6)
    assert got["d"].hull_area is None


def test_hull_against_brute_force():
    p = np.random.default_rng(1).random((60, 2))
    h = {tuple(x) for x in shapes.hull(p)}
    for i, a in enumerate(p):
        on = any(all((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) >= 0 for c in p) for j, b in enumerate(p) if j != i)
        assert (tuple(a) in h) == on


def test_delaunay_has_empty_circles():
    p = np.random.default_rng(2).random((40, 2))
    t = shapes.delaunay(p)
    assert abs(sum(shapes._area(p[list(x)]) for x in t) - shapes._area(shapes.hull(p))) < 1e-9


def test_outline_of_a_grid():
    p = np.array([(x, y) for x in range(6) for y in range(5)], float)
    assert shapes._area(shapes.concave_outline(p)) == pytest.approx(20, abs=1.1)
    assert shapes.concave_outline(p[:2]) is None


def test_point_in_ring(spark):
    v = geometry.rings(vertices(spark, a=CONCAVE))
    points = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (5.0, 1.0), (2.0, 0.0)], "x double, y double")
    got = points.crossJoin(v).select("x", "y", geometry.contains(F.col("ring"), F.col("x"), F.col("y")).alias("i"), geometry.on_outline(F.col("ring"), F.col("x"), F.col("y")).alias("o")).collect()
    assert {(r.x, r.y): (r.i, r.o) for r in got if r.x != 2 or r.y} == {(1, 1): (True, False), (2, 3): (False, False), (5, 1): (False, False)}
    assert [r.o for r in got if r.y == 0] == [True]


def test_pad_sample_scale(spark):
    r = geometry.rings(vertices(spark, a=SQUARE)).select(geometry.pad(F.col("ring"), 6).alias("p"), geometry.sample(F.col("ring"), 2).alias("s"), geometry.scale(F.col("ring"), 2.0).alias("d")).first()
    assert [tuple(x) for x in r.p] == [*SQUARE, (0, 0), (0, 0)]
    assert [tuple(x) for x in r.s] == [(0, 0), (0, 1)]
    assert {tuple(x) for x in r.d} == {(-0.5, -0.5), (1.5, -0.5), (1.5, 1.5), (-0.5, 1.5)}


def test_angle(spark):
    r = spark.range(1).select(geometry.angle(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(2.0)).alias("a"), geometry.angle(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(2.0)).alias("n")).first()
    assert math.isclose(r.a, 90) and r.n is None


def test_wkb_round_trip(spark):
    data = wkb.polygon(SQUARE)
    assert wkb.exterior(data) == [(0, 0), (1, 0), (1, 1), (0, 1)]
    df = spark.createDataFrame([("a", data), ("b", None)], "cell_id string, geometry binary")
    assert wkb.explode_wkb(df).count() == 4
    with pytest.raises(ValueError):
        wkb.exterior(b"\x01\x01\x00\x00\x00" + b"\0" * 16)
