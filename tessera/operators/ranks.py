"""Quantiles and running totals of whole tables without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import save

BINS = 4096
#: Rows of one bin that the driver sorts.
FEW = 20_000


def _order_statistics(df: DataFrame, column: str, ranks: list[int], low: float, high: float, before: int, n: int) -> dict[int, float]:
    """Values of the given ranks (from 0) among the ``n`` rows with values in [low, high], of which the first has rank ``before``."""
    inside = df.where(F.col(column).between(low, high))
    if low == high:
        return dict.fromkeys(ranks, low)
    if n <= FEW:
        values = sorted(r[0] for r in inside.select(column).collect())
        return {r: values[r - before] for r in ranks}
    part = F.least(F.floor((F.col(column) - low) / ((high - low) / BINS)), F.lit(BINS - 1)).cast("int")
    bins = sorted(inside.groupBy(part.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect())  # BINS rows at most
    out, at = {}, before
    for _, k, lo, hi in bins:
        here = [r for r in ranks if at <= r < at + k]
        if here:
            out |= _order_statistics(df, column, here, lo, hi, at, k)
        at += k
    return out


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles (linear between ranks) of a numeric column, by histograms that are refined only where the ranks fall.

    Null and NaN are left out; without rows every quantile is None.
    """
    df = df.select(F.col(column).cast("double").alias(column)).where(F.col(column).isNotNull() & ~F.isnan(column))
    n, low, high = df.agg(F.count("*"), F.min(column), F.max(column)).first()
    if not n:
        return [None] * len(shares)
    at = [s * (n - 1) for s in shares]
    ranks = sorted({r for x in at for r in (int(x), min(int(x) + 1, n - 1))})
    value = _order_statistics(df, column, ranks, low, high, 0, n)
    return [value[int(x)] + (x - int(x)) * (value[min(int(x) + 1, n - 1)] - value[int(x)]) for x in at]


def weighted_quantiles(df: DataFrame, column: str, weight: str, shares: list[float]) -> list[float | None]:
    """``quantiles`` of a table in which a row counts ``weight`` times (whole numbers of at least 1)."""
    df = df.select(F.col(column).cast("double").alias(column), F.col(weight).alias(weight)).where(F.col(column).isNotNull() & ~F.isnan(column))
    n, low, high = df.agg(F.sum(weight), F.min(column), F.max(column)).first()
    if not n:
        return [None] * len(shares)
    at = [s * (n - 1) for s in shares]
    ranks = sorted({r for x in at for r in (int(x), min(int(x) + 1, n - 1))})
    value, spans = {}, [(low, high, 0, ranks)]
    while spans:
        low, high, before, wanted = spans.pop()
        if low == high:
            value |= dict.fromkeys(wanted, low)
            continue
        part = F.least(F.floor((F.col(column) - low) / ((high - low) / BINS)), F.lit(BINS - 1)).cast("int")
        bins = df.where(F.col(column).between(low, high)).groupBy(part.alias("b")).agg(F.sum(weight).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
        for _, k, lo, hi in sorted(bins.collect()):  # BINS rows at most
            here = [r for r in wanted if before <= r < before + k]
            if here:
                spans.append((lo, hi, before, here))
            before += k
    return [value[int(x)] + (x - int(x)) * (value[min(int(x) + 1, n - 1)] - value[int(x)]) for x in at]


def running_total(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows up to each one in the order of a unique column.

    Rows are range-partitioned; a window runs within a range, over the totals of the ranges before.
    """
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = save(df.repartitionByRange(parts, order).withColumn("__range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("__range").agg(F.sum(value).alias("__sum"))
    # one row per range
    before = F.coalesce(F.sum("__sum").over(Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("__range", before.alias("__before"))
    own = F.sum(value).over(Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn(out, own).join(F.broadcast(totals), "__range").withColumn(out, F.col(out) + F.col("__before")).drop("__range", "__before")
