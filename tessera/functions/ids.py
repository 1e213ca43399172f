"""Ids, codes and label encoders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = "1996"


def coordinate_id(x: Column, y: Column) -> Column:
    """Deterministic 8-digit id of a position: md5 of its rounded thousandths and a seed.  Collisions are possible."""
    text = F.concat_ws("_", F.round(x * 1000).cast("long"), F.round(y * 1000).cast("long"))
    return F.conv(F.substring(F.md5(F.concat(text, F.lit(SEED))), 1, 8), 16, 10).cast("long") % 100_000_000


def wide_id(*columns: str) -> Column:
    """63-bit id for tables in which eight digits collide."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 63) - 1))


def ensure_ids(df: DataFrame, column: str = "transcript_id", wide: bool = True) -> DataFrame:
    """Adds ids only where the table has none."""
    if column in df.columns:
        return df
    others = [c for c in ("x", "y", "z", "gene") if c in df.columns]
    return df.withColumn(column, wide_id(*others) if wide else coordinate_id(F.col("x"), F.col("y")))


def tokens(df: DataFrame, column: str = "gene") -> DataFrame:
    """(label, token): labels in order, from 0.  One row per distinct label, a bounded panel."""
    labels = df.select(column).where(F.col(column).isNotNull()).distinct()
    return labels.withColumn("token", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(column)) - 1).cast("long"))


def embed(df: DataFrame, weights: DataFrame, column: str = "gene") -> DataFrame:
    """Rows with the weights of their label; rows without any go."""
    return df.join(weights, column)


def check_weights(weights: DataFrame, labels: DataFrame, column: str = "gene") -> None:
    """ValueError unless weights are unique and complete."""
    if weights.groupBy(column).count().where("count > 1").limit(1).count():
        raise ValueError("a label has several weights")
    if labels.select(column).distinct().join(weights, column, "left_anti").limit(1).count():
        raise ValueError("a label has no weights")


def fragment_id(component: Column) -> Column:
    """Eight letters from a component's number, and the suffix -nx."""
    return F.concat(F.translate(F.substring(F.md5(component.cast("string")), 1, 8), "0123456789abcdef", "abcdefghijklmnop"), F.lit("-nx"))


def hex_letters_to_int(cell: Column) -> Column:
    """aaaabbbb-1 -> the number whose hex digits are a..p for 0..f."""
    return F.conv(F.translate(F.split_part(cell, F.lit("-"), F.lit(1)), "abcdefghijklmnop", "0123456789abcdef"), 16, 10).cast("long")


def int_to_hex_letters(n: Column, suffix: int = 1) -> Column:
    return F.concat(F.translate(F.lpad(F.lower(F.hex(n)), 8, "0"), "0123456789abcdef", "abcdefghijklmnop"), F.lit(f"-{suffix}"))


def tile_uid(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.concat(F.lit("x="), x.cast("long"), F.lit("_y="), y.cast("long"), F.lit("_w="), w.cast("long"), F.lit("_h="), h.cast("long"))


def cluster_codes(df: DataFrame, column: str, code: str = "code") -> DataFrame:
    """Labels as 1..k in order, missing ones 0."""
    coded = tokens(df, column).select(column, (F.col("token") + 1).alias(code))
    return df.join(coded, column, "left").withColumn(code, F.coalesce(code, F.lit(0)))
