"""Whole runs: dataset creation and segmentation, each one lazy plan up to its writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import centroid, rings
from ..operators import graph, spatial_join
from ..sources import sinks
from ..sources.storage import save


def outline_centres(vertices: DataFrame) -> DataFrame:
    """(id, x, y) of outlines."""
    return rings(vertices).select(F.col("cell_id").alias("id"), centroid(F.col("ring")).alias("c")).select("id", "c.x", "c.y")


def places(points: DataFrame) -> DataFrame:
    """(id, x, y, z) of points; one without z is at 0."""
    z = F.coalesce(F.col("z").cast("double"), F.lit(0.0)) if "z" in points.columns else F.lit(0.0)
    return points.select(F.col("transcript_id").alias("id"), "x", "y", z.alias("z"))


def receptive_field(points: DataFrame, vertices: DataFrame, k_tx: int = 3, dist_tx: float = 5, k_bd: int = 3, dist_bd: float = 15) -> tuple[DataFrame, DataFrame]:
    """Edges point-point (in x, y, z) and point-outline."""
    p = places(points)
    return spatial_join.self_knn(p, k_tx, dist_tx, ("x", "y", "z"), include_self=False), spatial_join.knn_join(p, outline_centres(vertices), k_bd, dist_bd)


def assign(points: DataFrame, vertices: DataFrame, scores, cut: float = 0.5, **field) -> DataFrame:
    """transcript_id, cell_id, score, bound.  ``scores`` turns edges (src, dst, d) into edges with a score."""
    _, to_cells = receptive_field(points, vertices, **field)
    top = graph.best(scores(to_cells), cut)
    return graph.dedup_best(top.select(F.col("src").alias("transcript_id"), "cell_id", "score", "bound"))


def segment(points: DataFrame, vertices: DataFrame, scores, cut: float = 0.5, use_fragments: bool = True, k_tx: int = 3, dist_tx: float = 5, **field) -> DataFrame:
    """Every point with cell_id, score and bound: best outline where the score reaches the cut, else its connected fragment, else null."""
    _, to_cells = receptive_field(points, vertices, **field)
    top = graph.best(scores(to_cells), cut).select(F.col("src").alias("transcript_id"), "cell_id", "score", "bound")
    top = save(top, "best")
    taken = top.withColumn("cell_id", F.when(F.col("bound") == 1, F.col("cell_id")))
    out = graph.merge_points(points.drop("cell_id"), taken)
    if not use_fragments:
        return out.withColumn("cell_id", F.col("cell_id").cast("string"))
    assigned = taken.where("bound = 1").select(F.col("transcript_id").alias("id"), F.lit(True).alias("taken"))
    p = places(points).join(assigned, "id", "left").withColumn("taken", F.coalesce("taken", F.lit(False)))
    left = graph.leftover_neighbours(save(p, "points"), k_tx, dist_tx, ("x", "y", "z"), scores, cut)
    return graph.fill_unassigned(out, left)


def by_distance(reach: float):
    """A score without a model: 1 at distance 0, 0.5 at ``reach``."""
    return lambda edges: edges.withColumn("score", 1 / (1 + F.col("d") / F.lit(float(reach))))


def run_segmentation(points: DataFrame, vertices: DataFrame, scores, root: str, **parameters) -> None:
    """Segment and write the labelled points, the matrix and the log below ``root``."""
    from ..operators import matrix

    out = segment(points, vertices, scores, **parameters)
    sinks.write_labelled(out, f"{root}/transcripts")
    written = points.sparkSession.read.parquet(f"{root}/transcripts").withColumn("cell_id", F.expr("nullif(cell_id, 'UNASSIGNED')"))
    sinks.write_matrix(matrix.counts(written), matrix.cell_summary(written), matrix.gene_counts(written), f"{root}/matrix")
    sinks.write_log(points.sparkSession, parameters, f"{root}/log")
