"""The training dataset: overlapping tiles, each with nodes, edges, labels and a split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import area, centroid, rings
from ..functions.ids import tile_uid
from ..operators import filters, graph, shapes, spatial_join, tiling
from ..sources import readers, sinks
from ..sources.storage import save


@dataclass
class TileGraph:
    """Tables keyed by tile_id.

    tx: transcript_id, x, y, z, gene, nuclear, cell_id of the tile widened by the margin;
    bd: cell_id, x, y (centroid), area, convexity, elongation, circularity of owned outlines;
    tx_tx, tx_bd: neighbour edges (src, dst); belongs: labelled edges (src, dst, label);
    tiles: split and sizes of the tiles that stay.
    """

    tx: DataFrame
    bd: DataFrame
    tx_tx: DataFrame
    tx_bd: DataFrame
    belongs: DataFrame
    tiles: DataFrame


def _tiles(box, width: float, height: float) -> tuple[Column, Column, list[Column]]:
    """(tiles along x, along y) and the columns tile_id, x0, y0, x3, y3 of tile (i, j)."""
    nx, ny = (max(1, -int(-(hi - lo) // size)) for lo, hi, size in ((box.xmin, box.xmax, width), (box.ymin, box.ymax, height)))
    x0, y0 = F.lit(box.xmin) + F.col("i") * width, F.lit(box.ymin) + F.col("j") * height
    x3, y3 = F.least(x0 + width, F.lit(box.xmax)), F.least(y0 + height, F.lit(box.ymax))
    return nx, ny, [tile_uid(x0, y0, x3 - x0, y3 - y0).alias("tile_id"), x0.alias("x0"), y0.alias("y0"), x3.alias("x3"), y3.alias("y3")]


def in_tiles(rows: DataFrame, box, width: float, height: float, margin: float) -> DataFrame:
    """Each row (x, y, ...) once for every tile whose closed box, widened by ``margin``, holds it."""
    nx, ny, columns = _tiles(box, width, height)

    def span(c: str, low: float, size: float, n: int) -> Column:
        first = F.greatest(F.floor((F.col(c) - margin - low) / size) - 1, F.lit(0))
        last = F.least(F.floor((F.col(c) + margin - low) / size) + 1, F.lit(n - 1))
        return F.explode(F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))))

    out = rows.withColumn("i", span("x", box.xmin, width, nx)).withColumn("j", span("y", box.ymin, height, ny)).select(*rows.columns, *columns)
    return out.where(F.col("x").between(F.col("x0") - margin, F.col("x3") + margin) & F.col("y").between(F.col("y0") - margin, F.col("y3") + margin))


def tile_graph(points: DataFrame, vertices: DataFrame, width: float, height: float, margin: float = 10, k_tx: int = 3, dist_tx: float = 5, k_bd: int = 3, ratio: int = 5, train: float = 0.7, val: float = 0.1, frac: float = 1.0) -> TileGraph:
    """The graph of every tile; points, outlines and the tiles' sizes are saved in the shared folder.

    Edges and the tiles' points are plans over them, counted here and made when they are written:
    a saved copy of each would be many times the points.

    Neighbours are sought within a tile: up to ``k_tx`` points nearer than ``dist_tx`` (a point
    is its own first), up to ``k_bd`` owned outlines nearer than ten times the root of the
    tile's largest outline.  Nuclear points belong to their cell if the tile owns its
    outline; each such point gets ``ratio`` negative edges at most.  A tile without
    neighbour edges goes, one without labels is for testing.
    """
    tiling.check_tile_arguments(None, width, height)
    z = F.coalesce(F.col("z").cast("double"), F.lit(0.0)).alias("z")
    points = save(points.select("transcript_id", "x", "y", z, "gene", F.col("nuclear").cast("int").alias("nuclear"), "cell_id"), "points")
    box = readers.joint_extents(points, vertices).first()
    tx = in_tiles(points, box, width, height, margin).drop("x0", "y0", "x3", "y3")
    if frac < 1:
        wanted = save(tiling.sample_tiles(tx.select("tile_id").distinct(), frac), "tiles")
        tx = tx.join(F.broadcast(wanted), "tile_id", "left_semi")  # one row per tile
    size = lambda df, name: save(df.groupBy("tile_id").agg(F.count("*").alias(name)), name)
    n_tx = size(tx, "n_tx")
    owned = filters.owned_outlines(in_tiles(vertices.select("cell_id", "vertex_idx", "x", "y"), box, width, height, margin), margin)
    owned = owned.join(n_tx.select("tile_id"), "tile_id", "left_semi")
    ring = rings(vertices)
    looks = shapes.descriptors(vertices).select(F.col("cell_id").alias("key"), "convexity", "elongation", "circularity")
    cells = ring.select("cell_id", centroid(F.col("ring")).alias("c"), area(F.col("ring")).alias("area"), F.col("cell_id").cast("string").alias("key")).join(looks, "key")
    bd = save(owned.join(cells.select("cell_id", "c.x", "c.y", "area", "convexity", "elongation", "circularity"), "cell_id"), "tile-bd")
    p = tx.select("tile_id", F.col("transcript_id").alias("id"), "x", "y", "z")
    tx_tx = spatial_join.self_knn(p, k_tx, dist_tx, ("x", "y", "z"), by=("tile_id",)).select("tile_id", "src", "dst")
    reach = save(bd.groupBy("tile_id").agg((F.sqrt(F.max("area")) * 10).alias("reach")), "reach")
    widest = reach.agg(F.max("reach")).first()[0] or 1.0
    # the nearest ones within a tile's reach are the first of those within the widest
    near = spatial_join.knn_join(p.join(F.broadcast(reach.select("tile_id")), "tile_id", "left_semi"), bd.select("tile_id", F.col("cell_id").alias("id"), "x", "y"), k_bd, widest, by=("tile_id",))
    tx_bd = near.join(F.broadcast(reach), "tile_id").where("d < reach").select("tile_id", "src", "dst")
    n_tx_bd = size(tx_bd, "n_tx_bd")
    nuclear = tx.where("nuclear = 1 and cell_id is not null").join(bd.select("tile_id", "cell_id"), ["tile_id", "cell_id"], "left_semi")
    nuclear = nuclear.join(F.broadcast(n_tx_bd.select("tile_id")), "tile_id", "left_semi").select("tile_id", F.col("transcript_id").alias("src"), F.col("cell_id").alias("dst"))
    belongs = graph.negatives(tx_bd, nuclear, ratio, ("tile_id",))
    tiles = size(tx_tx, "n_tx_tx").join(n_tx, "tile_id")
    for df in (size(bd, "n_bd"), n_tx_bd, size(nuclear, "n_belongs")):
        tiles = tiles.join(df, "tile_id", "left")
    tiles = tiles.na.fill(0).withColumn("has_edges", F.col("n_belongs") > 0)
    tiles = save(tiling.assign_split(tiles, train, val).select("tile_id", "split", "n_tx", "n_bd", "n_tx_tx", "n_tx_bd", "n_belongs"), "tiles")
    here = lambda df: df.join(F.broadcast(tiles.select("tile_id", "split")), "tile_id")
    return TileGraph(*map(here, (tx, bd, tx_tx, tx_bd, belongs)), tiles)


def create_dataset(points: DataFrame, vertices: DataFrame, root: str, width: float, height: float, prefixes: tuple[str, ...] = (), min_qv: float | None = 20, **parameters) -> None:
    """A tile store below ``root``: a table of each part, partitioned by split, and the tiles' statistics."""
    g = tile_graph(filters.by_quality(points, prefixes, min_qv), vertices, width, height, **parameters)
    for name in ("tx", "bd", "tx_tx", "tx_bd", "belongs"):
        sinks.write_tiles(getattr(g, name), f"{root}/{name}")
    g.tiles.write.mode("errorifexists").parquet(f"{root}/tiles")
