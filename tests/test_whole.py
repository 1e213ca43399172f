"""Queries that cover all of their input, on small tables against brute force."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def rows(spark, name, sf_dir=SF):
    return catalogue.QUERIES[name](spark, sf_dir).collect()


@pytest.fixture(scope="module")
def embeddings(spark, tmp_path_factory):
    """A folder with 60 vectors, their ids and matrix, and the order of each one's neighbours."""
    r = np.random.default_rng(4)
    v, label = r.normal(size=(60, 8)).astype(np.float32), r.integers(0, 3, 60)
    root = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(i, v[i].tolist(), int(label[i])) for i in range(60)], "vec_id long, embedding array<float>, label int").write.parquet(f"{root}/embeddings.parquet")
    s = np.round(v.astype(float) @ v.astype(float).T, 9)
    np.fill_diagonal(s, -np.inf)
    near = np.argsort(-s, axis=1, kind="stable")
    return root, v.astype(float), label, s, near


def test_vector_queries_cover_all_vectors(spark, embeddings):
    root, v, label, s, near = embeddings
    k = catalogue.K_VECTORS
    want = {(i, int(j)) for i in range(60) for j in near[i, :k]}
    sig = lambda x: 1 / (1 + np.exp(-x))
    got = {(r.src, r.dst): r.score for r in rows(spark, "q_similarity", root)}
    assert set(got) == want and all(abs(got[i, j] - sig(s[i, j])) < 1e-5 for i, j in want)
    best = {r.src: r.score for r in rows(spark, "q_similarity_best", root)}
    assert len(best) == 60 and all(abs(best[i] - sig(s[i].max())) < 1e-5 for i in best)
    weight = {(r.src, r.dst): r.weight for r in rows(spark, "q_softmax", root)}
    assert set(weight) == want and all(abs(weight[i, j] - np.exp(s[i, j]) / np.exp(s[i, near[i, :k]]).sum()) < 1e-5 for i, j in want)
    votes = {i: np.bincount(label[near[i, :5]], minlength=3) for i in range(60)}
    assert {r.id: r.label for r in rows(spark, "q_label_transfer", root)} == {i: int(votes[i].argmax()) for i in votes}


def test_attention_layer_takes_all_vectors_and_dimensions(spark, embeddings):
    root, v, _, _, near = embeddings
    eye = np.full((8, 8), 0.1) + 0.9 * np.eye(8)
    l, att = v @ eye.T, np.array([0.5, -0.25, 0.25, 1.0] * 2)
    got = {r.id: r.h for r in rows(spark, "q_attention_layer", root)}
    assert len(got) == 60
    for i in range(60):
        j = near[i, : catalogue.K_VECTORS]
        z = l[j] + l[i]
        z = np.where(z > 0, z, 0.2 * z) @ att
        a = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert np.allclose(got[i], a @ l[j], atol=1e-5)


def test_link_scorer_sees_the_edges_of_all_vectors(spark, embeddings, monkeypatch):
    root, _, _, _, near = embeddings
    seen = []
    fit = catalogue.learn.fit_link_scorer
    monkeypatch.setattr(catalogue.learn, "fit_link_scorer", lambda f, *a: seen.extend((r.src, r.dst) for r in f.select("src", "dst").collect()) or fit(f, *a))
    assert len(rows(spark, "q_link_scorer", root)) == 1
    assert sorted(seen) == sorted((i, int(j)) for i in range(60) for j in near[i, : catalogue.K_VECTORS])


def equals_sql(spark, name, sf_dir=SF):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    got, want = catalogue.QUERIES[name](spark, sf_dir).toPandas(), con.sql(catalogue.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got)
    order = lambda d: d[cols].astype(object).sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)


@needs_tables
@pytest.mark.parametrize("name", ["q_runs", "q_calinski", "q_silhouette", "q_csr"])
def test_row_ranges_are_whole(spark, name):
    assert "where x <" not in catalogue.ORACLE_SQL[name] and "cell_id < 3000" not in catalogue.ORACLE_SQL[name]
    equals_sql(spark, name)


@needs_tables
def test_segment_keeps_every_point(spark):
    t = catalogue.Tables(spark, SF)
    assert sum(r.n for r in rows(spark, "q_segment")) == t.tx.count()


@needs_tables
@pytest.mark.parametrize("name", ["q_mecr", "q_mecr_by_area", "q_mecr_by_count", "q_cluster_medians", "q_sensitivity"])
def test_panels_are_whole(spark, name):
    equals_sql(spark, name)


@needs_tables
def test_panels_take_all_genes(spark):
    counts = catalogue.Tables(spark, SF).counts.collect()
    genes = sorted({r.gene for r in counts})
    assert len(genes) > 5 and len(rows(spark, "q_mecr")) == len(genes) * (len(genes) - 1) // 2
    wide = catalogue.QUERIES["q_count_pivot"](spark, SF)
    assert wide.columns == ["cell_id", *genes]
    assert {(r.cell_id, g): r[g] for r in wide.collect() for g in genes if r[g]} == {(r.cell_id, r.gene): r.n for r in counts}
