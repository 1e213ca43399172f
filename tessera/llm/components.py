"""Connected components of an edge table: contraction in tasks, then large-star and small-star rounds.

Every task replaces its share of the links (``PER_TASK`` at most) by a forest whose trees
are stars around the smallest node.  Where one task holds all links, that is the answer.
Else alternating rounds of two keyed minima and two joins go on with the forests; the
table is written to the shared folder between rounds, so no round depends on the memory
of one executor and no link reaches the driver (only a row count and a checksum do).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, lean, save

#: Links that one task contracts.
PER_TASK = 500_000


def stars(links) -> dict[int, int]:
    """Node -> smallest node of its component, of (u, v) pairs; roots are left out."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (p := parent.get(top, top)) != top:
            top = p
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for u, v in links:
        a, b = root(u), root(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent) if root(x) != x}


def _contract(it):
    import pyarrow as pa

    def pairs():
        for batch in it:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

    found = stars(pairs())
    yield pa.record_batch([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["u", "v"])


def _star(pairs: DataFrame) -> DataFrame:
    """Rows (u, v): each with the smallest node among u and all its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Self-links and repeated links do no harm; rows with a null end are ignored.
    An empty edge table gives an empty result.
    """
    e = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    links = save(e, "links")
    tasks = -(-links.count() // PER_TASK)
    # Parquet splits are not cut by rows: a task may get some more links than PER_TASK
    first = e = save(links.coalesce(max(1, tasks)).mapInArrow(lean(_contract), "u long, v long"), "links")
    before = None
    for _ in range(max_rounds if tasks > 1 else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _star(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        nxt = save(small.where("u <> v").distinct(), "links")
        state = tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if e is not first:
            drop(e)
        e = nxt
        if state == before:
            break
        before = state
    else:
        if tasks > 1:
            raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    drop(links)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
