"""Scans: points and outlines in canonical columns, regions, extents, metadata, tiles, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .profiles import Profile

# Bytes per value of a column's physical type.
WIDTH = {"boolean": 1, "int": 4, "float": 4, "bigint": 8, "double": 8, "string": 8, "binary": 8, "timestamp": 12}


def _text(df: DataFrame, column: str) -> Column:
    c = F.col(column)
    return F.decode(c, "UTF-8") if isinstance(df.schema[column].dataType, T.BinaryType) else c.cast("string")


def _need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")


def scan_points(spark: SparkSession, folder: str, profile: Profile) -> DataFrame:
    """transcript_id, x, y, z, gene, qv, nuclear, cell_id; what the platform lacks is null.

    A missing id column is filled by ``coordinate_id`` of the position; the source is
    never rewritten.
    """
    from ..functions.ids import ensure_ids

    p = profile.points
    df = spark.read.parquet(f"{folder}/{p.file}")
    _need(df, p.x, p.y, p.label)
    opt = lambda c, t: F.col(c).cast(t) if c and c in df.columns else F.lit(None).cast(t)
    nuclear = F.col(p.nuclear) == F.lit(p.nuclear_value) if p.nuclear and p.nuclear in df.columns else F.lit(None).cast("boolean")
    keep = [F.col(p.id).cast("long").alias("transcript_id")] if p.id in df.columns else []
    out = df.select(*keep, F.col(p.x).cast("double").alias("x"), F.col(p.y).cast("double").alias("y"), opt(p.z, "double").alias("z"), _text(df, p.label).alias("gene"), opt(p.quality, "double").alias("qv"), nuclear.alias("nuclear"), opt(p.cell_id, "string").alias("cell_id"))
    return ensure_ids(out)


def scan_vertices(spark: SparkSession, folder: str, profile: Profile) -> DataFrame:
    """cell_id, vertex_idx, x, y.  Ring order is the row order of the file, taken from the scan before any shuffle."""
    o = profile.outlines
    df = spark.read.parquet(f"{folder}/{o.file}")
    if o.geometry:
        from ..functions.wkb import explode_wkb

        _need(df, o.id, o.geometry)
        return explode_wkb(df.select(F.col(o.id).cast("string").alias("cell_id"), F.col(o.geometry).alias("geometry")))
    _need(df, o.id, o.x, o.y)
    return df.select(F.col(o.id).cast("string").alias("cell_id"), F.col("_metadata.row_index").alias("vertex_idx"), F.col(o.x).cast("double").alias("x"), F.col(o.y).cast("double").alias("y"))


def region(df: DataFrame, bounds: tuple[float, float, float, float] | None, extra: Column | None = None, closed: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Rows inside (x0, y0, x1, y1): an open box, or a closed one.  The predicate reaches the scan.  None: everything."""
    if bounds is not None:
        x0, y0, x1, y1 = map(float, bounds)
        x, y = F.col("x"), F.col("y")
        df = df.where((x >= x0) & (x <= x1) & (y >= y0) & (y <= y1) if closed else (x > x0) & (x < x1) & (y > y0) & (y < y1))
    if extra is not None:
        df = df.where(extra)
    return df.select(*columns) if columns else df


def extents(df: DataFrame) -> DataFrame:
    """One row: xmin, ymin, xmax, ymax."""
    return df.agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))


def joint_extents(a: DataFrame, b: DataFrame) -> DataFrame:
    """The box of both tables."""
    both = extents(a).unionByName(extents(b))
    return both.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


def metadata(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: n_rows, n_columns, row_bytes by the columns' types; KeyError on a missing column."""
    columns = columns or df.columns
    _need(df, *columns)
    width = sum(WIDTH.get(dict(df.dtypes)[c], 8) for c in columns)
    return df.agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(len(columns)).cast("long").alias("n_columns"), F.lit(width).cast("long").alias("row_bytes"))


def set_metadata(df: DataFrame) -> DataFrame:
    """Extents, rows and genes in one pass."""
    return df.agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"), F.count("*").alias("n_rows"), F.countDistinct("gene").alias("n_genes"))


def features(df: DataFrame, prefixes: tuple[str, ...] = (), weights: DataFrame | None = None) -> DataFrame:
    """Distinct genes that are no controls and, if given, have weights."""
    from ..operators.filters import no_controls

    out = no_controls(df.select("gene"), prefixes).distinct()
    return out if weights is None else out.join(weights.select("gene").distinct(), "gene", "left_semi")


def common_genes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Genes that two tables share."""
    return a.select("gene").intersect(b.select("gene"))


def genes_without(a: DataFrame, b: DataFrame) -> DataFrame:
    """Genes of a table that another lacks."""
    return a.select("gene").distinct().join(b.select("gene").distinct(), "gene", "left_anti")


def read_tiles(spark: SparkSession, root: str, split: str | None = None) -> DataFrame:
    """Rows of a tile store written by ``sinks.write_tiles``; the split prunes folders."""
    df = spark.read.parquet(root)
    return df.where(F.col("split") == split) if split else df


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    """Training order: by seeded hash of the whole row, so that a re-run repeats it."""
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns))


def split_methods(df: DataFrame, column: str = "cell_id", name: str = "tessera") -> DataFrame:
    """Adds method_part: cells that fragments made (suffix -nx) are name_n0, others name_n1."""
    return df.withColumn("method_part", F.when(F.col(column).endswith("-nx"), f"{name}_n0").otherwise(f"{name}_n1"))


def latest_checkpoint(files: DataFrame, column: str = "path") -> DataFrame:
    """The path with the greatest (epoch, step) in its name; one row, null if none has both."""
    epoch, step = (F.regexp_extract(column, rf"{k}=(\d+)", 1).cast("long") for k in ("epoch", "step"))
    return files.select(column, epoch.alias("epoch"), step.alias("step")).where("epoch is not null and step is not null").agg(F.max(F.struct("epoch", "step", column)).alias("m")).select(f"m.{column}", "m.epoch", "m.step")


def one_match(spark: SparkSession, folder: str, pattern: str) -> str:
    """The only file of ``folder`` that a glob matches; otherwise an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    names = [str(x.getPath()) for x in found]
    if len(names) != 1:
        raise FileNotFoundError(f"{len(names)} files match {pattern} in {folder}")
    return names[0]
