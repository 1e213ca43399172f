"""Scores and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(a: Column) -> Column:
    """Scaled to length 1; the zero vector stays."""
    n = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double")))


def sigmoid(s: Column) -> Column:
    return 1 / (1 + F.exp(-s))


def link_score(s: Column) -> Column:
    """Sigmoid; a similarity of exactly 0 means no link and scores 0."""
    return F.when(s == 0, F.lit(0.0)).otherwise(sigmoid(s))


def relu(a: Column) -> Column:
    return F.transform(a, lambda x: F.greatest(x, F.lit(0.0)))


def leaky_relu(a: Column, slope: float = 0.2) -> Column:
    return F.transform(a, lambda x: F.when(x > 0, x).otherwise(x * slope))


def rounded(c: Column, k: int) -> Column:
    """``round(c, k)`` of doubles; only those near a tie, negative or large take its decimal arithmetic."""
    scaled = c * F.lit(10.0**k)
    clear = (c >= 0) & (scaled < 2.0**32) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-4)
    return F.when(clear, F.floor(scaled + 0.5).cast("double") / F.lit(10.0**k)).otherwise(F.round(c, k))


def softmax(df: DataFrame, group: list[str], logit: str, out: str = "weight") -> DataFrame:
    """Weights per group; the greatest logit is taken off first."""
    top = df.groupBy(*group).agg(F.max(logit).alias("__top"))
    df = df.join(top, group).withColumn("__e", F.exp(F.col(logit) - F.col("__top")))
    total = df.groupBy(*group).agg(F.sum("__e").alias("__sum"))
    return df.join(total, group).withColumn(out, F.col("__e") / F.col("__sum")).drop("__top", "__e", "__sum")


def normalise(counts: DataFrame, target: float = 1e4, log: bool = True) -> DataFrame:
    """(cell_id, gene, n) with value = n * target / cell total, then ln(1 + value)."""
    value = F.col("n") * target / F.sum("n").over(Window.partitionBy("cell_id"))
    return counts.withColumn("value", F.log1p(value) if log else value)


def no_nan(c: Column) -> Column:
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
