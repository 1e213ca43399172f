"""Sinks.  Nothing overwrites its input."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tiles(df: DataFrame, root: str) -> None:
    """A tile store, partitioned by split; rows of a tile stand together.  The folder must not exist yet."""
    df.repartition("split", "tile_id").sortWithinPartitions("tile_id").write.partitionBy("split").mode("errorifexists").parquet(root)


def write_assignments(df: DataFrame, path: str, bound_only: bool = False) -> None:
    """transcript_id string, score float, cell_id string, bound byte; appended."""
    out = df.where("bound = 1") if bound_only else df
    out.select(F.col("transcript_id").cast("string"), F.col("score").cast("float"), F.col("cell_id").cast("string"), F.col("bound").cast("byte")).write.mode("append").parquet(path)


def write_labelled(df: DataFrame, path: str) -> None:
    """Final labelled points; missing cells are written out as UNASSIGNED."""
    df.withColumn("cell_id", F.coalesce(F.col("cell_id").cast("string"), F.lit("UNASSIGNED"))).write.option("compression", "snappy").parquet(path)


def write_matrix(counts: DataFrame, obs: DataFrame, var: DataFrame, path: str) -> None:
    """An annotated matrix as three tables: X (cell, gene, n), obs, var."""
    for name, df in (("X", counts), ("obs", obs), ("var", var)):
        df.write.parquet(f"{path}/{name}")


def write_outlines(rings: DataFrame, path: str) -> None:
    """Cell outlines sorted by cell, in row groups small enough to skip by cell."""
    rings.repartitionByRange("cell_id").sortWithinPartitions("cell_id").write.option("parquet.block.size", 1 << 20).parquet(path)


def write_augmented(points: DataFrame, path: str) -> None:
    """A source table with its generated ids, to a new folder; a table without ids gets them from its positions."""
    from ..functions.ids import ensure_ids

    ensure_ids(points).write.mode("errorifexists").option("compression", "snappy").parquet(path)


def write_field_outlines(vertices: DataFrame, path: str) -> None:
    """Outlines of an instrument that works by fields of view: ordered by fov, cell and vertex, in small row groups."""
    order = [c for c in ("fov", "cell", "cell_id", "vertex_idx") if c in vertices.columns]
    vertices.repartitionByRange(*order[:2]).sortWithinPartitions(*order).write.option("parquet.block.size", 1 << 16).option("parquet.block.row.count.limit", 1000).parquet(path)


def explorer_cells(points: DataFrame, vertices: DataFrame, n_vertices: int = 13, min_points: int = 5, window: tuple[float, float] | None = None) -> DataFrame:
    """The cell table of a viewer: cell_id, n, hull_area, centroid, z_level, ring of ``n_vertices`` corners, row (by cell_id)."""
    from ..functions.geometry import pad, rings, sample, z_level
    from ..operators.ranks import running_total
    from ..operators.shapes import point_hulls

    held = points.where("cell_id is not null")
    s = held.groupBy("cell_id").agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), z_level(F.avg("z")).alias("z_level"))
    s = s.where(F.col("n") >= min_points).join(point_hulls(held), "cell_id")
    if window is not None:
        s = s.where(F.col("hull_area").between(*window))
    corners = rings(vertices).select("cell_id", pad(sample(F.col("ring"), n_vertices), n_vertices).alias("ring"))
    s = s.join(corners, "cell_id", "left")
    return running_total(s.withColumn("one", F.lit(1)), "cell_id", "one", "row").drop("one")


def write_explorer(points: DataFrame, vertices: DataFrame, groups: DataFrame, path: str, **parameters) -> None:
    """A viewer's store as tables: cells, and the rows of each analysis group (cell_id, grouping, label)."""
    cells = explorer_cells(points, vertices, **parameters)
    cells.write.mode("errorifexists").parquet(f"{path}/cells")
    rows = points.sparkSession.read.parquet(f"{path}/cells").select("cell_id", "row")
    groups.join(rows, "cell_id").select("grouping", "label", "row").repartition("grouping").sortWithinPartitions("grouping", "label", "row").write.partitionBy("grouping").parquet(f"{path}/analysis")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_log(spark, parameters: dict, path: str) -> None:
    """Run parameters as one JSON line."""
    spark.createDataFrame([(json.dumps(parameters, sort_keys=True),)], "value string").coalesce(1).write.text(path)


def run_name(**parameters) -> str:
    """Folder name of a run, from its parameters."""
    return "_".join(f"{k}={v}" for k, v in sorted(parameters.items()))
