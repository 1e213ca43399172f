import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry, ids, vectors
from tessera.operators import components, filters, graph, learn, metrics, ranks, spatial_join, tiling
from tessera.plans import dataset, segment
from tessera.sources import masks, profiles, readers, sinks


def points(spark, rows):
    return spark.createDataFrame([(i, float(x), float(y)) for i, x, y in rows], "id long, x double, y double")


def test_knn_ties_and_strict_bound(spark):
    left, right = points(spark, [(0, 0, 0)]), points(spark, [(3, 1, 0), (1, 0, 1), (2, -1, 0), (4, 2, 0)])
    got = spatial_join.knn_join(left, right, 2, 2).collect()
    assert [(r.src, r.dst) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1), (0, 2)]
    assert {r.dst for r in spatial_join.knn_join(left, right, 9, 2).collect()} == {1, 2, 3}


def test_joins_equal_brute_force_and_never_cross(spark):
    r = random.Random(3)
    rows = [(i, r.uniform(-30, 30), r.uniform(-30, 30)) for i in range(250)]
    df = points(spark, rows)
    out = spatial_join.radius_graph(df, 4.0)
    want = {(a, b) for a, x, y in rows for b, u, v in rows if a != b and math.dist((x, y), (u, v)) <= 4}
    assert {(x.src, x.dst) for x in out.collect()} == want
    plan = out._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    near = {x.id: x.d for x in spatial_join.nearest(df, 0.5).collect()}
    assert len(near) == 250 and all(math.isclose(near[a], min(math.dist((x, y), (u, v)) for b, u, v in rows if b != a)) for a, x, y in rows)


def test_prefix_filter(spark):
    df = spark.createDataFrame([("BLANK_2", 30.0), ("xBLANK_", 30.0), (None, 30.0), ("a", 10.0)], "gene string, qv double")
    assert [r.gene for r in filters.by_quality(df, ("BLANK_",)).collect()] == ["xBLANK_"]
    assert filters.by_quality(df.drop("qv"), ("BLANK_",)).count() == 2


def test_components_any_order(spark):
    edges = [(1, 2), (2, 3), (4, 5), (9, 3), (7, 7)]
    for e in (edges, edges[::-1]):
        got = {r.node: r.component for r in components.components(spark.createDataFrame(e, "src long, dst long")).collect()}
        assert got == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4}
    assert components.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_dedup_and_fill(spark):
    a = spark.createDataFrame([(1, 0.2, "c", 0), (1, 0.9, "b", 1), (1, 0.9, "a", 1), (1, None, "z", 0)], "transcript_id long, score double, cell_id string, bound int")
    assert graph.dedup_best(a).first().cell_id == "a"
    p = spark.createDataFrame([(1, None), (2, None), (3, None), (4, "k")], "transcript_id long, cell_id string")
    got = {r.transcript_id: r.cell_id for r in graph.fill_unassigned(p, spark.createDataFrame([(1, 2)], "src long, dst long")).collect()}
    assert got[1] == got[2] and got[1].endswith("-nx") and got[3] is None and got[4] == "k"


def test_qcut_right_closed(spark):
    got = metrics.quantile_bins(spark.range(1, 11), "id", 5).groupBy("bin").count().collect()
    assert {r.bin: r["count"] for r in got} == {i: 2 for i in range(1, 6)}


def test_tiles(spark):
    r = random.Random(5)
    df = points(spark, [(i, r.random() * 100, r.random() * 100) for i in range(1000)])
    sizes = [x["count"] for x in tiling.tag(df, tiling.regions(df, 7)).groupBy("tile").count().collect()]
    assert len(sizes) == 7 and sum(sizes) == 1000 and max(sizes) - min(sizes) <= 8
    sizes = [x["count"] for x in tiling.tag(df, tiling.balanced(df, 300)).groupBy("tile").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 300
    assert tiling.rectangular(df, readers.extents(df), 30, 30).groupBy("tile_id").count().agg(F.sum("count")).first()[0] == 1000
    with pytest.raises(ValueError):
        tiling.balanced(df, 10)
    with pytest.raises(ValueError):
        tiling.check_tile_arguments(5, 3, 3)
    with pytest.raises(ValueError):
        tiling.sample_tiles(spark.range(5).withColumnRenamed("id", "tile_id"), 2)


def test_ids(spark):
    df = spark.createDataFrame([("ffkpbaba-1",)], "c string").withColumn("n", ids.hex_letters_to_int(F.col("c")))
    assert df.first().n == 0x55AF1010 and df.select(ids.int_to_hex_letters(F.col("n"))).first()[0] == "ffkpbaba-1"
    p = spark.createDataFrame([(1.0, 2.0, "a"), (1.0, 2.5, "a")], "x double, y double, gene string")
    assert ids.ensure_ids(p).select("transcript_id").distinct().count() == 2
    assert ids.ensure_ids(p.withColumn("transcript_id", F.lit(1))).columns[-1] == "transcript_id"
    w = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "gene string, w double")
    with pytest.raises(ValueError):
        ids.check_weights(w, p)


def test_profiles_and_scans(spark, tmp_path):
    df = spark.createDataFrame([(100, 100, "gene1", 1), (200, 200, "gene2", 2)], "x_global_px long, y_global_px long, target string, cell long")
    df.write.parquet(str(tmp_path / "transcripts.parquet"))
    got = readers.scan_points(spark, str(tmp_path), profiles.load_profile("CosMx"))
    assert got.columns == ["x", "y", "z", "gene", "qv", "nuclear", "cell_id", "transcript_id"] or set(got.columns) >= {"transcript_id", "gene", "qv"}
    assert got.select("transcript_id").distinct().count() == 2 and got.where("qv is not null").count() == 0
    plan = readers.region(got, (150, 150, 300, 300))._jdf.queryExecution().toString()
    assert "PushedFilters" in plan or "DataFilters" in plan
    with pytest.raises(FileNotFoundError):
        profiles.load_profile("nothing")
    with pytest.raises(KeyError):
        readers.metadata(got, ["nope"])
    b = spark.createDataFrame([(1, float(x), float(y)) for x, y in [(0, 0), (1, 0), (1, 1)]], "cell long, x_global_px double, y_global_px double")
    b.coalesce(1).write.parquet(str(tmp_path / "nucleus_boundaries.parquet"))
    assert [r.vertex_idx for r in readers.scan_vertices(spark, str(tmp_path), profiles.PROFILES["cosmx"]).orderBy("vertex_idx").collect()] == [0, 1, 2]


def test_whole_run(spark, tmp_path):
    ring = [(0, 0), (4, 0), (4, 4), (0, 4)]
    v = spark.createDataFrame([(c, i, float(x + dx), float(y)) for c, dx in ((1, 0), (2, 20)) for i, (x, y) in enumerate(ring)], "cell_id long, vertex_idx long, x double, y double")
    p = spark.createDataFrame([(1, 2.0, 2.0, "a", 1, 1), (2, 2.5, 2.0, "b", 1, 1), (3, 22.0, 2.0, "a", 1, 2), (4, 50.0, 2.0, "a", 0, None), (5, 50.5, 2.0, "b", 0, None), (6, 80.0, 2.0, "b", 0, None)], "transcript_id long, x double, y double, gene string, nuclear int, cell_id long")
    segment.run_segmentation(p, v, segment.by_distance(5), str(tmp_path / "run"))
    got = {r.transcript_id: r.cell_id for r in spark.read.parquet(str(tmp_path / "run/transcripts")).collect()}
    assert (got[1], got[2], got[3], got[6]) == ("1", "1", "2", "UNASSIGNED") and got[4] == got[5] and got[4].endswith("-nx")


def square(cell, x, y, size=4):
    return [(cell, i, float(x + dx), float(y + dy)) for i, (dx, dy) in enumerate([(0, 0), (size, 0), (size, size), (0, size)])]


VERTICES = "cell_id long, vertex_idx long, x double, y double"
POINTS = "transcript_id long, x double, y double, z double, gene string, nuclear int, cell_id long"


def test_dataset(spark, tmp_path):
    v = spark.createDataFrame(square(1, 40, 40) + square(2, 60, 40) + square(3, 97, 50), VERTICES)
    rows = [(1, 42, 42, 0, 1, 1), (2, 43, 42, 0, 1, 1), (3, 62, 42, 0, 1, 2), (4, 43, 42, 9, 0, None), (5, 99, 52, 0, 1, 3), (6, 0, 0, 0, 0, None), (7, 130, 100, 0, 0, None)]
    p = spark.createDataFrame([(i, float(x), float(y), float(z), "a", n, c) for i, x, y, z, n, c in rows], POINTS).withColumn("qv", F.lit(None).cast("double"))
    dataset.create_dataset(p, v, str(tmp_path / "tiles"), 100, 100)
    read = lambda name: spark.read.parquet(str(tmp_path / "tiles" / name))
    assert {(r.src, r.dst) for r in read("belongs").where("label = 1").collect()} == {(1, 1), (2, 1), (3, 2)}
    assert {r.cell_id for r in read("bd").collect()} == {1, 2} and {r.split for r in read("bd").collect()} <= {"train", "val", "test"}
    tt = {(r.src, r.dst) for r in read("tx_tx").collect()}
    assert (1, 2) in tt and (1, 1) in tt and (1, 4) not in tt  # z counts
    tiles = {r.tile_id: r for r in read("tiles").collect()}
    assert len(tiles) == 2 and sorted(r.n_tx for r in tiles.values()) == [2, 6]  # point 5 stands in both
    assert {r.split for r in tiles.values() if not r.n_belongs} == {"test"}
    with pytest.raises(Exception):
        sinks.write_tiles(read("belongs"), str(tmp_path / "tiles" / "belongs"))


def test_platform_without_quality_keeps_its_points(spark):
    df = spark.createDataFrame([("a", None), ("b", None)], "gene string, qv double")
    assert filters.by_quality(df, (), 20).count() == 2
    assert filters.by_quality(spark.createDataFrame([("a", 19.0), ("b", 20.0)], "gene string, qv double"), (), 20).count() == 1


def test_self_pairs_equal_pairs(spark):
    r = random.Random(1)
    rows = [(i, r.uniform(-9, 9), r.uniform(-9, 9), r.uniform(-2, 2), i % 2) for i in range(150)]
    p = spark.createDataFrame(rows, "id long, x double, y double, z double, g int")
    for dims in (("x", "y"), ("x", "y", "z")):
        for by in ((), ("g",)):
            a = spatial_join.pairs_within(p, p, 2.5, dims, by=by).select("src", "dst", F.round("d", 9))
            b = spatial_join.self_pairs(p, 2.5, dims, by=by).select("src", "dst", F.round("d", 9))
            assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_nearest_has_no_bound(spark):
    p = points(spark, [(1, 0, 0), (2, 1, 0), (3, 1e6, 1e6)])
    got = {r.id: r.d for r in spatial_join.nearest(p, 1e-3).collect()}
    assert got[1] == got[2] == 1 and got[3] == pytest.approx(math.hypot(1e6 - 1, 1e6))
    assert spatial_join.nearest(points(spark, [(1, 0, 0)]), 1.0).count() == 0


def test_points_in_rings_of_all_sizes(spark):
    r, rings = random.Random(2), {}
    for c in range(12):
        n, size, cx, cy = r.randrange(3, 9), 10 ** r.uniform(-1, 2.5), r.uniform(-50, 50), r.uniform(-50, 50)
        rings[c] = [(cx + size * r.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), cy + size * r.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    v = spark.createDataFrame([(c, k, x, y) for c, ring in rings.items() for k, (x, y) in enumerate(ring)], VERTICES)
    rows = [(i, r.uniform(-80, 80), r.uniform(-80, 80)) for i in range(400)]
    want = set()
    for i, x, y in rows:
        for c, ring in rings.items():
            inside = False
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                    inside = not inside
            if inside:
                want.add((i, c))
    assert {(r.id, r.cell_id) for r in spatial_join.points_in_rings(points(spark, rows), v).collect()} == want and len(want) > 50
    assert spatial_join.points_in_rings(points(spark, rows), v.limit(0)).count() == 0


def test_quantiles_and_running_totals(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(ranks, "FEW", 20)
    monkeypatch.setattr(ranks, "BINS", 16)
    r = np.random.default_rng(3)
    values = [*r.normal(size=500), *[1.5] * 300, 1e9, -1e9]
    df = spark.createDataFrame([(float(x),) for x in values] + [(None,), (float("nan"),)], "v double")
    shares = [0.0, 0.1, 0.5, 0.77, 0.999, 1.0]
    assert ranks.quantiles(df, "v", shares) == pytest.approx(list(np.quantile(values, shares)))
    assert ranks.quantiles(df.limit(0), "v", [0.5]) == [None]
    t = ranks.running_total(spark.createDataFrame([(i, i % 7) for i in range(300)], "k long, n long"), "k", "n", "upto")
    assert {x.k: x.upto for x in t.collect()} == dict(enumerate(np.cumsum([i % 7 for i in range(300)]).tolist()))


def test_network_forward_pass(spark):
    import numpy as np

    from tessera.operators import network

    w = network.random_weights(5, 3, 4, 3, 1, 2, 2, seed=1)
    r = np.random.default_rng(2)
    tokens, looks = r.integers(0, 5, 6), r.normal(size=(3, 3))
    tt = [(a, b) for a in range(6) for b in range(6) if (a + b) % 3 == 0]
    tb = [(a, b) for a in range(6) for b in range(2)]  # outline 2 has no edge
    tx = spark.createDataFrame([(i, int(t)) for i, t in enumerate(tokens)], "id long, x long")
    bd = spark.createDataFrame([(i, [float("nan") if (i, k) == (0, 0) else float(v) for k, v in enumerate(x)]) for i, x in enumerate(looks)], "id long, x array<double>")
    edge = lambda e: spark.createDataFrame(e, "src long, dst long")
    a, b = network.forward(tx, bd, edge(tt), edge(tb), w)
    looks[0, 0] = 0

    def layer(source, target, edges, w):
        heads, c = w["att"].shape
        left, right = source @ w["left"].T + w["left_bias"], target @ w["right"].T + w["right_bias"]
        out = np.tile(w["bias"], (len(target), 1))
        for i in range(len(target)):
            js = [s for s, d in edges if d == i]
            for h in range(heads):
                z = left[js][:, h * c : h * c + c] + right[i, h * c : h * c + c]
                z = (np.where(z > 0, z, 0.2 * z) * w["att"][h]).sum(1)
                if len(js):
                    e = np.exp(z - z.max())
                    out[i, h * c : h * c + c] += (e / e.sum()) @ left[js][:, h * c : h * c + c]
        return out

    p, q = np.maximum(w["embedding"][tokens], 0), np.maximum(looks @ w["lin0"].T, 0)
    for k, l in enumerate(w["layers"]):
        p, q = layer(p, p, tt, l["tx_tx"]), layer(p, q, tb, l["tx_bd"])
        if k < len(w["layers"]) - 1:
            p, q = np.maximum(p, 0), np.maximum(q, 0)
    for got, want in ((a, p), (b, q)):
        assert {r.id: r.h for r in got.collect()} == {i: pytest.approx(list(x)) for i, x in enumerate(want)}
    scored = network.network_scores(a, b)(edge(tb)).collect()
    assert all(r.score == pytest.approx(1 / (1 + math.exp(-float(p[r.src] @ q[r.dst])))) for r in scored) and len(scored) == len(tb)


def test_mask_outlines(spark):
    import numpy as np

    m = np.zeros((12, 14), int)
    m[2:6, 3:9] = 1
    m[4, 5] = 0  # a hole does not count
    m[8:11, 1:3] = 2
    m[9, 12] = 2  # a speck of the same label neither
    df = spark.createDataFrame([(7, 14, m.ravel().tolist()), (8, 2, [0, 0])], "fov long, width int, labels array<int>")
    got = masks.mask_outlines(df).collect()
    ring = lambda k: {(r.x, r.y) for r in got if r.cell == k}
    assert ring(1) == {(3, 2), (9, 2), (9, 6), (3, 6)} and ring(2) == {(1, 8), (3, 8), (3, 11), (1, 11)} and {r.fov for r in got} == {7}


def test_sinks_of_viewer_and_fields(spark, tmp_path):
    v = spark.createDataFrame(square(1, 0, 0) + square(2, 10, 0), VERTICES)
    rows = [(i, float(i % 3), float(i % 2), 4.0, "a", 1, 1 + i // 6) for i in range(12)]
    p = spark.createDataFrame(rows, POINTS)
    groups = spark.createDataFrame([(1, "kind", "x"), (2, "kind", "y")], "cell_id long, grouping string, label string")
    sinks.write_explorer(p, v, groups, str(tmp_path / "viewer"))
    cells = {r.cell_id: r for r in spark.read.parquet(str(tmp_path / "viewer/cells")).collect()}
    assert cells[1].hull_area == 2 and len(cells[1].ring) == 13 and (cells[1].row, cells[2].row) == (1, 2) and cells[1].z_level == 3
    assert spark.read.parquet(str(tmp_path / "viewer/analysis")).count() == 2
    assert filters.viable_cells(p, 5, (1.0, 3.0)).count() == 2 and filters.viable_cells(p, 5, (3.0, 9.0)).count() == 0
    sinks.write_field_outlines(v.withColumn("fov", F.lit(1)), str(tmp_path / "fields"))
    assert spark.read.parquet(str(tmp_path / "fields")).count() == 8
    sinks.write_augmented(p.drop("transcript_id"), str(tmp_path / "augmented"))
    back = spark.read.parquet(str(tmp_path / "augmented"))
    assert back.where("transcript_id is null").count() == 0 and back.count() == 12
    r = geometry.rings(v.unionByName(spark.createDataFrame([(3, 0, 0.0, 0.0), (3, 1, 1.0, 1.0)], VERTICES))).withColumn("s", geometry.valid_scaled(F.col("ring"), 2.0))
    assert {x.cell_id: x.s is None for x in r.collect()} == {1: False, 2: False, 3: True}


def test_commands(spark, tmp_path):
    from tessera import cli

    p = spark.createDataFrame([(i, 40.0 + i % 3, 40.0 + i % 2, 0.0, "a", 30.0, 1, "1") for i in range(20)] + [(90, 0.0, 0.0, 0.0, "a", 30.0, 0, None), (91, 100.0, 100.0, 0.0, "a", 30.0, 0, None)], "transcript_id long, x_location double, y_location double, z_location double, feature_name string, qv double, overlaps_nucleus int, cell_id string")
    p.coalesce(1).write.parquet(str(tmp_path / "raw/transcripts.parquet"))
    spark.createDataFrame([("1", x, y) for _, _, x, y in square(1, 39, 39)], "cell_id string, vertex_x double, vertex_y double").coalesce(1).write.parquet(str(tmp_path / "raw/nucleus_boundaries.parquet"))
    base = ["--base_dir", str(tmp_path / "raw"), "--sample_type", "xenium"]
    cli.main(["create_dataset", *base, "--data_dir", str(tmp_path / "tiles"), "--tile_width", "100", "--tile_height", "100"], spark)
    assert spark.read.parquet(str(tmp_path / "tiles/belongs")).where("label = 1").count() == 20
    cli.main(["segment", *base, "--save_dir", str(tmp_path / "run")], spark)
    assert spark.read.parquet(str(tmp_path / "run/transcripts")).where("cell_id = '1'").count() == 20
    cli.main(["validate", "--segmented", str(tmp_path / "run/transcripts"), "--out", str(tmp_path / "report")], spark)
    assert spark.read.parquet(str(tmp_path / "report/tuning")).count() == 1


def test_scores(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>")
    r = df.select(vectors.link_score(vectors.dot(F.col("a"), F.col("b"))).alias("z"), vectors.link_score(vectors.dot(F.col("a"), F.col("a"))).alias("s")).first()
    assert r.z == 0 and math.isclose(r.s, 1 / (1 + math.exp(-1)))
    s = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.4), (0, 0.4)], "label int, score double")
    e = learn.evaluate(s).first()
    assert e.auroc == pytest.approx(0.875) and e.f1 == pytest.approx(2 / 3)


def test_attention_layer(spark):
    n = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id long, h array<double>")
    e = spark.createDataFrame([(1, 3), (2, 3)], "src long, dst long")
    eye = [[1.0, 0.0], [0.0, 1.0]]
    h = graph.attention_layer(n, e, eye, eye, [1.0, 0.0]).first().h
    w = math.exp(2.0) / (math.exp(2.0) + math.exp(1.0))
    assert h == pytest.approx([w, 1 - w])


def test_stream(spark, tmp_path):
    from tessera.streaming import ingest

    src = spark.createDataFrame([(5.0, 5.0, "a", 30.0), (5.0, 6.0, "BLANK_1", 30.0), (15.0, 5.0, "a", 5.0)], "x double, y double, gene string, qv double")
    src.write.parquet(str(tmp_path / "in"))
    s = ingest.tiled(ingest.stream_points(spark, str(tmp_path / "in"), src.schema, ("BLANK_",)), 10)
    ingest.run_available(s, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [r.tile_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["x=0_y=0_w=10_h=10"]


@pytest.mark.parametrize("group", [10**9, 50])
def test_boxes_against_recursion(spark, monkeypatch, group):
    import numpy as np

    monkeypatch.setattr(tiling, "GROUP", group)
    r = np.random.default_rng(5)
    p = np.round(r.normal(size=(700, 2)) * [5, 2], 2)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id long, x double, y double")

    def cut(some, most, n=None):
        if (n == 1) if n else len(some) <= most:
            return [len(some)]
        k = 0 if np.ptp(some[:, 0]) >= np.ptp(some[:, 1]) else 1
        q = np.quantile(some[:, k], (n // 2) / n if n else 0.5)
        return cut(some[some[:, k] <= q], most, n and n // 2) + cut(some[some[:, k] > q], most, n and n - n // 2)

    for boxes, want in ((tiling.balanced(df, 110), cut(p, 110)), (tiling.regions(df, 5), cut(p, 0, 5))):
        tagged = tiling.tag(df, boxes).groupBy("tile").count().collect()
        assert sorted(x["count"] for x in tagged) == sorted(want) and len(boxes) == len(want)
