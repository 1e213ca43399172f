"""Bounded labelled samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

#: Files of a sample's table at most: its rows are few, and for each file an executor may start processes (Hadoop's chmod).
FILES = 8


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, trains: bool, bound: int, most_bytes: int) -> DataFrame:
    """Saved (doc_id, text, y): the first labelled rows by hash of their id, ``bound`` at most, with ``most_bytes`` of text at most.

    With ``trains`` the rows outside fold ``held``, else those in it.  Rows without label
    or id are left out; an id with several labels counts with the largest; rows that repeat
    id and text count once.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    in_fold = fold_of(F.col("doc_id"), folds) == held
    ids = ids.where(~in_fold if trains else in_fold).groupBy("doc_id").agg(F.max("y").alias("y"))
    ids = save(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound), "labelled-ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # at most ``bound`` ids of 12 bytes
    rows = texts.join(F.broadcast(ids), "doc_id").withColumn("t", F.xxhash64("text")).dropDuplicates(["doc_id", "t"])
    rows = save(rows.coalesce(FILES), "labelled")
    # the first ``bound`` rows, and of these as many as the bytes allow: a running sum over ``bound`` narrow rows
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("t")]
    first = rows.select("doc_id", "t", F.octet_length("text").cast("long").alias("bytes")).orderBy(*order).limit(bound)
    held_bytes = F.sum("bytes").over(Window.partitionBy(F.lit(0)).orderBy(*order))
    first = save(first.withColumn("held", held_bytes).where((F.col("held") <= most_bytes)).select("doc_id", "t"), "labelled-rows")
    return save(rows.join(F.broadcast(first), ["doc_id", "t"]).select("doc_id", "text", "y").coalesce(FILES), "labelled")
