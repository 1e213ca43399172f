"""Exact dedup over a cuckoo-filter index of live digests.

``CuckooIndex`` keeps a cuckoo filter (two candidate buckets of four 16-bit
fingerprints per key) in front of bucketed content: the full digests with their
values.  A filter miss proves a key new; a hit is verified against the content
bucket.  Keys can be deleted.  When an insertion finds no free slot, the filter
doubles and is filled again from the stored keys, so nothing is ever lost.

``exact_dedup`` reads texts once, keeps one index per task first (a group of copies
leaves at most a row for each flush of a task) and one index per digest partition
after a shuffle of those rows.  The number of partitions follows the row count, so
an index holds a bounded number of keys whatever the size of the table.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, shuffle_partitions

SLOTS, KICKS = 4, 200
#: Keys an index of one task or partition is sized for.
KEYS_PER_INDEX = 100_000


class CuckooIndex:
    """Digest (bytes, 16 or more) -> value, with insertion, deletion and lookup."""

    def __init__(self, buckets: int = 1024):
        self.size = 0
        self.resizes = 0
        self._make(1 << max(1, (buckets - 1).bit_length()))

    def _make(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.filter = array("H", bytes(2 * SLOTS * buckets))
        self.content: list[dict | None] = [None] * buckets

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        one = int.from_bytes(digest[2:10], "little") & self.mask
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995 >> 3)) & self.mask

    def _in_filter(self, mark: int, one: int, two: int) -> bool:
        f, a, b = self.filter, one * SLOTS, two * SLOTS
        return mark in f[a : a + SLOTS] or mark in f[b : b + SLOTS]

    def get(self, digest: bytes):
        """The value of a live digest, else None."""
        mark, one, two = self._places(digest)
        if not self._in_filter(mark, one, two):
            return None
        return (self.content[one] or {}).get(digest)

    def put(self, digest: bytes, value) -> None:
        """Insert a digest, or set the value of a live one."""
        mark, one, two = self._places(digest)
        held = self.content[one]
        if held is not None and self._in_filter(mark, one, two) and digest in held:
            held[digest] = value
            return
        if held is None:
            held = self.content[one] = {}
        held[digest] = value
        self.size += 1
        if not self._seat(mark, one, two):
            self._grow()

    def delete(self, digest: bytes) -> bool:
        """Remove a live digest; False if it is not live."""
        mark, one, two = self._places(digest)
        held = self.content[one]
        if held is None or digest not in held:
            return False
        del held[digest]
        self.size -= 1
        for bucket in (one, two):
            for i in range(bucket * SLOTS, (bucket + 1) * SLOTS):
                if self.filter[i] == mark:
                    self.filter[i] = 0
                    return True
        raise AssertionError("a live digest has a fingerprint")

    def _seat(self, mark: int, one: int, two: int) -> bool:
        f = self.filter
        for bucket in (one, two):
            for i in range(bucket * SLOTS, (bucket + 1) * SLOTS):
                if not f[i]:
                    f[i] = mark
                    return True
        bucket = two
        for k in range(KICKS):
            i = bucket * SLOTS + (mark + k) % SLOTS
            f[i], mark = mark, f[i]
            bucket = self._other(bucket, mark)
            for j in range(bucket * SLOTS, (bucket + 1) * SLOTS):
                if not f[j]:
                    f[j] = mark
                    return True
        return False

    def _grow(self) -> None:
        """Double until every stored key has a seat."""
        keys = list(self.items())
        buckets = (self.mask + 1) * 2
        while True:
            self.resizes += 1
            self._make(buckets)
            for digest, value in keys:
                mark, one, two = self._places(digest)
                held = self.content[one]
                if held is None:
                    held = self.content[one] = {}
                held[digest] = value
                if not self._seat(mark, one, two):
                    break
            else:
                return
            buckets *= 2

    def items(self) -> Iterator[tuple[bytes, object]]:
        for held in self.content:
            if held:
                yield from held.items()

    def __len__(self) -> int:
        return self.size


_OUT = "digest binary, bytes long, no_id boolean, doc_id long, row long, size long"


def _merge(flush_at: int | None):
    """Rows of _OUT -> one row per digest and index: the least (no_id, doc_id, row) and the summed size."""

    def out(index: CuckooIndex) -> pd.DataFrame:
        rows = [(d[:32], int.from_bytes(d[32:], "little"), *v) for d, v in index.items()]
        return pd.DataFrame(rows, columns=["digest", "bytes", "no_id", "doc_id", "row", "size"])

    def run(it):
        index = CuckooIndex()
        for pdf in it:
            for digest, n, no_id, doc_id, row, size in zip(pdf["digest"], pdf["bytes"], pdf["no_id"], pdf["doc_id"], pdf["row"], pdf["size"]):
                key = digest + int(n).to_bytes(8, "little")
                mine = (bool(no_id), int(doc_id), int(row), int(size))
                held = index.get(key)
                if held is None:
                    index.put(key, mine)
                else:
                    index.put(key, min(held, mine)[:3] + (held[3] + mine[3],))
            if flush_at and len(index) >= flush_at:
                yield out(index)
                index = CuckooIndex()
        if len(index):
            yield out(index)

    return run


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` became one
    space; null is the empty text.  Of equal texts the row with the smallest doc_id
    stays (null last; among rows that repeat an id, exactly one).  ``keep_id`` is null
    only where no row of the group has an id.  Other columns are not read.  An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), "[ \\t\\n\\x0B\\f\\r]+", " ")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    rows = rows.select("doc_id", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"), F.octet_length("t").cast("long").alias("bytes"))
    rows = save(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    parts = max(shuffle_partitions(spark), -(-rows.count() // KEYS_PER_INDEX))
    # no null goes to pandas: a column of longs with nulls would come as floats, which round ids above 2^53
    single = rows.select("digest", "bytes", F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "row", F.lit(1).cast("long").alias("size"))
    local = single.mapInPandas(_merge(KEYS_PER_INDEX), _OUT)
    groups = local.repartition(parts, "digest").mapInPandas(_merge(None), _OUT)
    groups = groups.select("digest", "bytes", F.when(~F.col("no_id"), F.col("doc_id")).alias("keep_id"), F.col("row").alias("keep_row"), F.col("size").alias("group_size"))
    out = rows.join(groups, ["digest", "bytes"])
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def live_index(docs: DataFrame) -> DataFrame:
    """A persisted index: the live (digest, bytes, doc_id) of every row of ``docs``."""
    text = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), "[ \\t\\n\\x0B\\f\\r]+", " ")
    return docs.select(F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"), F.col("doc_id").cast("long").alias("doc_id"))


def _changes(pdf_iter):
    """Within one digest partition: rows in order of (kind); inserts count, deletions take back."""
    index = CuckooIndex()
    for pdf in pdf_iter:
        for digest, n, doc_id, gone in zip(pdf["digest"], pdf["bytes"], pdf["doc_id"], pdf["gone"]):
            key = digest + int(n).to_bytes(8, "little") + int(doc_id).to_bytes(8, "little", signed=True)
            if gone:
                index.delete(key)
            else:
                index.put(key, (digest, int(n), int(doc_id)))
    if len(index):
        yield pd.DataFrame([v for _, v in index.items()], columns=["digest", "bytes", "doc_id"])


def update_index(index: DataFrame, inserted: DataFrame, deleted: DataFrame) -> DataFrame:
    """The live rows after inserting ``inserted`` (documents) and then deleting ``deleted`` (doc_id, text).

    Rows without doc_id are ignored, since nothing could delete them again.
    """
    rows = index.select("digest", "bytes", "doc_id", F.lit(False).alias("gone"))
    rows = rows.unionByName(live_index(inserted).withColumn("gone", F.lit(False))).unionByName(live_index(deleted).withColumn("gone", F.lit(True)))
    rows = rows.where("doc_id is not null")
    parts = shuffle_partitions(index.sparkSession)
    return rows.repartition(parts, "digest", "doc_id").sortWithinPartitions("gone").mapInPandas(_changes, "digest binary, bytes long, doc_id long")


__all__ = ["CuckooIndex", "exact_dedup", "live_index", "update_index"]
