"""Nearest neighbours where points are many or stand at one place."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessera.functions import vectors
from tessera.operators import components, graph, knn, ranks, spatial_join
from tessera.plans import dataset, segment


def brute(left, right, k, distance, include_self=True):
    out = set()
    for i, *p in left:
        d = sorted((sum((a - b) * (a - b) for a, b in zip(p, q)) ** 0.5, j) for j, *q in right)
        near = [(x, j) for x, j in d if x < distance and (include_self or i != j)]
        out |= {(i, j, round(x, 9), r + 1) for r, (x, j) in enumerate(near[:k])}
    return out


def points(dims, seed=5):
    r = np.random.default_rng(seed)
    spread = r.uniform(-40, 90, (120, dims)).round(1)
    grid = r.integers(0, 4, (80, dims)) * 0.4  # ties
    dense = 30 + r.normal(size=(60, dims)) * 1e-3
    same = np.full((50, dims), 64.0)  # at a tile's corner
    rows = [p.tolist() for p in np.concatenate([spread, grid, dense, same])]
    return [(int(i), *p) for i, p in zip(r.permutation(len(rows)), rows)]


@pytest.mark.parametrize("dims", [("x", "y"), ("x", "y", "z")])
@pytest.mark.parametrize("include_self", [True, False])
def test_self_knn_equals_brute_force(spark, dims, include_self):
    p = points(len(dims))
    got = spatial_join.self_knn(spark.createDataFrame(p, ["id", *dims]), 3, 2.0, dims, include_self=include_self)
    assert {(r.src, r.dst, round(r.d, 9), r.rank) for r in got.collect()} == brute(p, p, 3, 2.0, include_self)


def test_knn_join_equals_brute_force_and_leaves_out_rows_without_a_place(spark):
    p, q = points(2), points(2, 6)
    odd = [(1000, None, 1.0), (1001, float("nan"), 1.0), (1002, float("inf"), 1.0)]
    left, right = (spark.createDataFrame([*rows, *odd], "id long, x double, y double") for rows in (p, q))
    got = spatial_join.knn_join(left, right, 4, 1.5)
    assert {(r.src, r.dst, round(r.d, 9), r.rank) for r in got.collect()} == brute(p, q, 4, 1.5)


def test_knn_within_groups_and_with_text_ids(spark):
    p = points(2)
    df = spark.createDataFrame([(f"t{i % 2}", f"n{i:04d}", x, y) for i, x, y in p], ["tile_id", "id", "x", "y"])
    got = {(r.tile_id, r.src, r.dst, round(r.d, 9), r["rank"]) for r in spatial_join.self_knn(df, 3, 5.0, by=("tile_id",)).collect()}
    want = set()
    for t in (0, 1):
        some = [(f"n{i:04d}", x, y) for i, x, y in p if i % 2 == t]
        want |= {(f"t{t}", *r) for r in brute(some, some, 3, 5.0)}
    assert got == want


def test_knn_forms_no_pairs_outside_its_tasks(spark):
    """A join on cells forms every pair within the distance, here 400 million."""
    df = spark.range(20_000).selectExpr("id", "1.0D as x", "2.0D as y", "0.5D as z")
    for dims in (("x", "y"), ("x", "y", "z")):
        out = spatial_join.self_knn(df, 3, 2.0, dims, include_self=False)
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
        rows = out.collect()
        assert len(rows) == 60_000 and {r.dst for r in rows} == {0, 1, 2, 3}


def test_knn_sends_python_one_number_beside_the_rows(spark):
    """Each column costs with every row; two keys of a tile would also be compared row by row."""
    df = spark.createDataFrame(points(2), "id long, x double, y double")
    plan = spatial_join.self_knn(df, 3, 2.0)._jdf.queryExecution().executedPlan().toString()
    (call,) = [line for line in plan.splitlines() if "FlatMapGroupsInArrow" in line]
    sent = call[call.index("run(") :].split(")")[0]
    assert [c.strip().split("#")[0] for c in sent[len("run(") :].split(",")] == ["id", "x", "y", "__at"]
    assert [line.count(" ASC ") for line in plan.splitlines() if "Sort [" in line] == [1]


def test_knn_beyond_the_outermost_tile(spark):
    p = [(i, s * x, y) for i, (s, x, y) in enumerate((s, x, y) for s in (-1, 1) for x in (1e13, 1e13 + 1, 2e13, 137438953000.0) for y in (0.0, 1.5, -4e13))]
    got = spatial_join.self_knn(spark.createDataFrame(p, "id long, x double, y double"), 3, 2.0)
    assert {(r.src, r.dst, round(r.d, 9), r.rank) for r in got.collect()} == brute(p, p, 3, 2.0)


def test_order_by_one_number_is_the_order_by_all(spark):
    r = np.random.default_rng(3)
    d = np.concatenate([r.uniform(0, 2, 500), 1 + r.integers(0, 9, 500) * 2.0**-52, np.nextafter(2.0, 0) - r.integers(0, 2, 100) * 2.0**-52, np.zeros(100)])
    owner, ids = r.integers(0, 7, len(d)), r.permutation(len(d))
    assert (knn._order(owner, d, ids, 2.0) == np.lexsort((ids, d, owner))).all()
    assert (knn._order(owner, d * 1e-300, ids, 2e-300) == np.lexsort((ids, d * 1e-300, owner))).all()


def test_rounded_equals_round(spark):
    r = np.random.default_rng(4)
    ties = (r.integers(0, 4_000_000, 2000) + 0.5) / 1e6
    values = [*ties, *np.nextafter(ties, 0), *np.nextafter(ties, 9), *r.uniform(0, 2, 2000), *r.uniform(-2, 1e9, 500), 0.0, -0.0, 1e300, -0.0000005, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    assert df.where(~F.round("v", 6).eqNullSafe(vectors.rounded(F.col("v"), 6))).count() == 0


def test_leftover_pairs_equal_the_edges_of_all_pairs(spark):
    p = [(i, x, y, f"g{i % 2}") for i, x, y in points(2)]
    df = spark.createDataFrame(p, "id long, x double, y double, gene string")
    taken = spark.createDataFrame([(i,) for i in range(0, 400, 3)], "id long")
    score = lambda d: 1 / (1 + d)
    edges = spatial_join.self_pairs(df, 4, by=("gene",)).withColumn("score", score(F.col("d")))
    for cut, above in ((0.25, True), (None, False)):
        want = sorted(map(tuple, graph.leftover_edges(edges, taken, cut, above).select("src", "dst").collect()))
        got = graph.leftover_pairs(df, taken, 4, score, cut, above, by=("gene",))
        assert want and sorted(map(tuple, got.select("src", "dst").collect())) == want


def test_leftover_pairs_of_one_place_are_rows_of_the_result_only(spark):
    """20,000 points at one place, of which two are free: 400 million pairs count for the median."""
    df = spark.range(20_000).selectExpr("id", "1.0D as x", "2.0D as y")
    got = graph.leftover_pairs(df, df.where("id > 1").select("id"), 4, lambda d: 1 / (1 + d), 0.25)
    assert sorted(map(tuple, got.select("src", "dst").collect())) == [(0, 1), (1, 0)]
    assert ranks.weighted_quantiles(spark.createDataFrame([(1.0, 3), (2.0, 1), (4.0, 2)], "v double, n long"), "v", "n", [0.0, 0.5, 0.7, 1.0]) == [1.0, 1.5, 3.0, 4.0]


def test_tile_graph_saves_no_edges_and_counts_what_it_gives(spark, monkeypatch):
    saved, save = [], dataset.save
    monkeypatch.setattr(dataset, "save", lambda df, name: saved.append((name, df.columns)) or save(df, name))
    p = spark.range(3000).selectExpr("id as transcript_id", "cast(id % 30 as double) as x", "cast(id % 20 as double) as y", "null as z", "'g' as gene", "1 as nuclear", "id % 2 as cell_id")
    ring = [(c, i, 8.0 + 8 * c + dx, 10.0 + dy) for c in (0, 1) for i, (dx, dy) in enumerate([(0, 0), (3, 0), (3, 3), (0, 3)])]
    g = dataset.tile_graph(p, spark.createDataFrame(ring, "cell_id long, vertex_idx int, x double, y double"), 40, 40, margin=2)
    assert not [n for n, columns in saved if {"src", "dst"} & set(columns)]
    (t,) = g.tiles.collect()
    assert (t.n_tx, t.n_bd, t.n_tx_tx) == (3000, 2, 9000) and t.n_tx_bd > 0 and t.n_belongs == 3000
    for name in ("tx", "bd", "tx_tx", "tx_bd"):
        assert getattr(g, name).count() == t[f"n_{name}"]
    assert g.belongs.where("label = 1").count() == t.n_belongs


def test_components_contract_in_tasks_and_link_what_tasks_share(spark, monkeypatch):
    r = np.random.default_rng(7)
    chain = [(i, i + 1) for i in range(1000, 1400)]
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))]
    links = chain + pairs
    label = {n: n for e in links for n in e}
    for _ in range(len(label)):
        new = dict(label)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            break
        label = new
    want = {n: c for n, c in label.items() if any(n in e and e[0] != e[1] for e in links)}
    rounds, save = [], components.save
    monkeypatch.setattr(components, "save", lambda df, name: rounds.append(name) or save(df, name))
    df = spark.createDataFrame([links[i] for i in r.permutation(len(links))], "src long, dst long")
    for n, held in ((8, 4_000_000), (3, 50), (1, 4_000_000)):
        monkeypatch.setattr(components, "HELD", held)
        rounds.clear()
        got = components.components(df.repartition(n)).collect()
        assert len(got) == len(want) and {g.node: g.component for g in got} == want
    assert rounds.count("edges") <= 3  # one task holds all: the chain of 400 needs no rounds of its own
    text = components.components(df.selectExpr("concat('n', src) as src", "concat('n', dst) as dst").repartition(4)).collect()
    assert len({t.component for t in text}) == len(set(want.values()))


def test_segment_saves_no_edges_between_points(spark, monkeypatch):
    p = spark.range(2000).selectExpr("id as transcript_id", "cast(id % 4 * 50 as double) as x", "0.0D as y", "1.0D as z", "cast(null as long) as cell_id")
    ring = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate([(-2.0, -2.0), (2.0, -2.0), (2.0, 2.0), (-2.0, 2.0)])], "cell_id long, vertex_idx int, x double, y double")
    saved = []
    for module in (segment, graph):
        monkeypatch.setattr(module, "save", lambda df, name, f=module.save: saved.append(df.columns) or f(df, name))
    got = segment.segment(p, ring, segment.by_distance(10), dist_tx=2).collect()
    assert saved and not [c for c in saved if {"src", "dst"} <= set(c)]
    assert len(got) == 2000 and len({g.cell_id for g in got}) == 4 and sum(g.bound == 1 and g.cell_id == "1" for g in got) == 500
