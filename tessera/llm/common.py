"""Shared pieces of the training-data operators.

* ``save``: write an intermediate table to the shared checkpoint folder and read
  it back.  That cuts lineage in a place that every executor and the driver can
  reach, so a lost executor costs a re-read and not a re-run.
* byte-level word splitting and hashing over Arrow buffers.  A word is a run of
  bytes outside ``[\\x20\\x09-\\x0D]``; hashes are positional sums modulo 2^64 over
  a random byte table, taken from one running sum per slice of text, so the cost
  per byte is a few numpy passes.  A slice holds at most ``SLICE`` bytes: memory
  stays bounded however long a batch or a single text is.
* ``lean``: Python workers outlive their tasks; a task gives back what it used.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

SLICE = 1 << 20
U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where unset (tests on one machine), a local one that this process removes."""
    try:
        base = spark.conf.get("spark.checkpoint.dir")
    except Exception:  # no such setting
        base = None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def save(df: DataFrame, name: str, codec: str = "zstd", row_group: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.

    ``.scratch`` of the result is its path, for ``drop``.  ``row_group``: bytes of a
    Parquet row group, for tables of large rows.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.option("compression", codec)
    if row_group:
        writer = writer.option("parquet.block.size", row_group)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete saved tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "scratch", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished plans deleted.

    The engine deletes them once the driver collects the plans that made them, which may
    be long after their rows were written to a table by ``save``.
    """
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# -- memory of a Python worker ----------------------------------------------------------

#: What operators remember in a worker from task to task: operator -> functions that forget it.
REMEMBERED_BY: dict[str, list[Callable[[], None]]] = {}


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # not glibc
    _trim = int


def tidy() -> None:
    """Give the system back what the allocators of this worker keep of freed memory.

    They keep several times what a task needs at once, and an idle worker keeps it while
    the JVM beside it works on.
    """
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    _trim(0)


def forget(but: str = "") -> None:
    """Let go what other operators than ``but`` remember in this worker."""
    for name, lets_go in REMEMBERED_BY.items():
        if name != but:
            for let_go in lets_go:
                let_go()


def lean(run: Callable) -> Callable:
    """``run``, the function of mapInArrow, for workers that outlive their tasks: it forgets what other operators remember and is tidy after each batch."""

    def lean_run(it):
        def tidied():
            for batch in it:
                yield batch
                del batch
                tidy()

        forget()
        yield from run(tidied())
        tidy()

    return lean_run


def lean_group(answer: Callable) -> Callable:
    """The same for a function from tables of a group to one table."""

    def lean_answer(*tables):
        forget()
        try:
            return answer(*tables)
        finally:
            tidy()

    # Spark takes the group's key for a further parameter, so the number of parameters must show
    return (lambda table: lean_answer(table)) if answer.__code__.co_argcount == 1 else (lambda left, right: lean_answer(left, right))


# -- bytes of an Arrow string column ---------------------------------------------------


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string array; null counts as empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def row_slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


# -- words -----------------------------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        a = np.full(max(n, SLICE + 1), base, U64)
        a[0] = 1
        have = _powers[base] = np.multiply.accumulate(a)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of each word; words never cross row offsets."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~SPACE[buf]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cut = offsets[(offsets > 0) & (offsets < len(buf))]
    first[cut] |= solid[cut]
    last[cut - 1] |= solid[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans of ``buf``: equal for equal bytes, wherever they stand."""
    run = np.zeros(len(buf) + 1, U64)
    np.cumsum(_BYTE[buf] * _power(_P, len(buf)), out=run[1:])
    h = (run[ends] - run[starts]) * _power(_P_INV, len(buf) + 1)[starts]
    return mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def gram_hashes(buf: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the q bytes from each place on."""
    n = len(buf) - q + 1
    if n < 1:
        return np.zeros(0, U64)
    run = np.zeros(len(buf) + 1, U64)
    np.cumsum(_BYTE[buf] * _power(_P, len(buf)), out=run[1:])
    return mix((run[q:] - run[:-q]) * _power(_P_INV, len(buf) + 1)[:n])


def row_words(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of rows i..j: hashes of their lower-cased words and the word offsets of the rows.

    A row above SLICE bytes is read in windows that end at white space.
    """
    for i, j in row_slices(offsets):
        at = offsets[i : j + 1] - offsets[i]
        part = buf[offsets[i] : offsets[j]]
        if len(part) <= SLICE:
            s, e = words(part, at)
            yield i, j, span_hashes(LOWER[part], s, e), np.searchsorted(s, at)
            continue
        found, a = [], 0
        while a < len(part):
            b = min(len(part), a + SLICE)
            while b < len(part) and not SPACE[part[b]]:
                b += 1  # a word is never cut
            s, e = words(part[a:b], np.array([0, b - a]))
            found.append(span_hashes(LOWER[part[a:b]], s, e))
            a = b
        h = np.concatenate(found)
        yield i, j, h, np.array([0, len(h)])


def row_word_offsets(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """For slices of rows i..j: the word offsets of the rows, without hashes."""
    for i, j in row_slices(offsets):
        part, at = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        yield i, j, np.searchsorted(words(part, at)[0], at)


def shingles(h: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its n-word shingles; with fewer words the whole sequence as one."""
    acc = None
    if len(h) >= n:
        acc = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            acc = acc * U64(0xA24BAED4963EE407) + h[k : len(h) - n + 1 + k]
        acc = mix(acc)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= n:
            out.append(np.unique(acc[a : b - n + 1]))
        elif b > a:
            x = U64(b - a)
            with np.errstate(over="ignore"):
                for w in h[a:b]:
                    x = x * U64(0x8CB92BA72F3D8DD7) + w
            out.append(mix(np.array([x], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def batches(table_batch, columns: list[str]) -> list:
    """The named columns of an Arrow record batch."""
    return [table_batch.column(table_batch.schema.get_field_index(c)) for c in columns]
