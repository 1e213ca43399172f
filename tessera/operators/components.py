"""Connected components of an edge table: alternating large-star and small-star rounds over written tables.

Each task first replaces its edges by trees of depth one; only the roots of nodes that
several trees hold take part in the rounds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import drop, save


def _with_least(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


#: Edges that a task contracts at a time.
HELD = 4_000_000


def _roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component."""
    f = np.arange(n)
    while len(u):
        a, b = f[u], f[v]
        differ = a != b
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(f, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(g := f[f], f):
            f = g
    return f


def _contract(it):
    import pyarrow as pa

    def trees(held):
        table = pa.Table.from_batches(held)
        ends = pa.concat_arrays([c for name in ("u", "v") for c in table.column(name).chunks])
        if pa.types.is_integer(ends.type):
            nodes, code = np.unique(ends.to_numpy(zero_copy_only=False), return_inverse=True)
        else:
            values = ends.to_pylist()
            nodes = sorted(set(values))
            at = {x: i for i, x in enumerate(nodes)}
            code = np.fromiter((at[x] for x in values), np.int64, len(values))
        f = _roots(code[: table.num_rows], code[table.num_rows :], len(nodes))
        nodes = pa.array(nodes, ends.type)
        return pa.record_batch([nodes, nodes.take(pa.array(f))], names=["node", "root"])

    held, n = [], 0
    for batch in it:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= HELD:
            yield trees(held)
            held, n = [], 0
    if held:
        yield trees(held)


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component), undirected; component is the smallest node.  Nodes without an edge to another are not listed."""
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    kind = dict(e.dtypes)["u"]
    trees = e.mapInArrow(_contract, f"node {kind}, root {kind}")
    nodes = save(trees.groupBy("node").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots")).select("node", "root", F.when(F.size("roots") > 1, F.col("roots")).alias("roots")), "nodes")
    links = nodes.where("roots is not null").select(F.col("root").alias("u"), F.explode("roots").alias("v")).where("u <> v")
    least = _stars(links, max_rounds).withColumnRenamed("node", "root")
    return nodes.select("node", "root").join(least, "root", "left").select("node", F.coalesce("component", "root").alias("component"))


def _stars(edges: DataFrame, max_rounds: int) -> DataFrame:
    """The large-star and small-star rounds of edges (u, v)."""
    e = save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _with_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        nxt = save(small.where("u <> v").distinct(), "edges")
        drop(e)
        e = nxt
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        before = state
    raise RuntimeError("components did not settle")
