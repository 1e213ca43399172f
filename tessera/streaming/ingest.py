"""Points arriving as files: filtered, tiled and counted as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import tile_uid
from ..operators.filters import by_quality


def stream_points(spark: SparkSession, folder: str, schema, prefixes: tuple[str, ...] = (), min_qv: float | None = 20) -> DataFrame:
    """A stream over a folder of point files in canonical columns, controls and low quality dropped."""
    return by_quality(spark.readStream.schema(schema).parquet(folder), prefixes, min_qv)


def tiled(points: DataFrame, size: float) -> DataFrame:
    corner = lambda c: F.floor(F.col(c) / size) * size
    return points.withColumn("tile_id", tile_uid(corner("x"), corner("y"), F.lit(size), F.lit(size)))


def tile_counts(points: DataFrame, size: float) -> DataFrame:
    """Running counts per tile and gene: keyed state that grows with tiles, not points."""
    return tiled(points, size).groupBy("tile_id", "gene").agg(F.count("*").alias("n"))


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Process what is there and stop; files are committed exactly once."""
    return df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
