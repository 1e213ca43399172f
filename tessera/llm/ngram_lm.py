"""Stupid-backoff scores of every document under an n-gram model of the whole corpus.

The relational plan (count tables partitioned by n-gram hash, joined to the exploded
n-grams of the documents, summed per document) in packed rows:

1. Texts are gathered into blocks of some megabytes, one row each.
2. A block's n-grams of all orders are exploded, hashed and made distinct with their
   counts, and sent to their hash partition: one row per block and partition, sorted
   hashes as an Elias-Fano list.  An n-gram crosses the shuffle once per block, however
   often documents repeat it, so frequent n-grams are no hot keys.
3. A partition merges its rows into the count table and answers each block with the
   corpus counts of the n-grams it asked for.
4. Blocks meet their answers, look up every n-gram occurrence, back off where needed
   and sum per document.

Counts leave out the document's own occurrences, so backing off means something on
the corpus that made the counts.  With c' such counts and N all words:
S(w | v) = c'(v w) / c'(v) if c'(v w) > 0, else 0.4 S(w); S(w) = max(c'(w), 0.5) / N.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, batches, lean, lean_group, mix, row_word_offsets, row_words, save, shuffle_partitions, utf8

ALPHA = 0.4
UNSEEN = 0.5
#: Bits of an n-gram's hash.  Among k distinct n-grams, about k / 2^56 share one.
HASH_BITS = 56
BLOCK_BYTES = 8 << 20
#: Effort of the compression of a block's texts, which are written once and sent once.
LEVEL = 9
#: n-grams that one partition of the count table is asked for.
PER_PARTITION = 3_000_000
ROW_GROUP = 16 << 20


def _blocks(it):
    import pyarrow as pa
    import zstandard

    part, seq = TaskContext.get().partitionId(), 0
    ids: list = []
    parts: list[bytes] = []
    sizes: list[int] = []
    held = n_words = 0

    def out():
        # ids are whole numbers wherever they go; the rows without one are told apart by place
        known = [0 if i is None else i for i in ids]
        nameless = [k for k, i in enumerate(ids) if i is None]
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (known, nameless, sizes)]
        return pa.record_batch([pa.array([(part << 32) + seq], pa.int64()), *lists, pa.array([zstandard.compress(b"".join(parts), LEVEL)], pa.binary()), pa.array([held], pa.int64()), pa.array([n_words], pa.int64())], names=["block", "ids", "nameless", "sizes", "texts", "bytes", "words"])

    for batch in it:
        docs, texts = batches(batch, ["doc_id", "text"])
        buf, offsets = utf8(texts)
        counts = np.concatenate([np.zeros(0, np.int64), *(np.diff(at) for _, _, at in row_word_offsets(buf, offsets))]).tolist()
        for i, doc in enumerate(docs.to_pylist()):
            raw = buf[offsets[i] : offsets[i + 1]].tobytes()
            if held and held + len(raw) > BLOCK_BYTES:
                yield out()
                seq, ids, parts, sizes, held, n_words = seq + 1, [], [], [], 0, 0
            ids.append(doc)
            parts.append(raw)
            sizes.append(len(raw))
            held += len(raw)
            n_words += counts[i]
    if ids:
        yield out()


def _grams(packed: bytes, sizes: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(words per document, per order the hash that ends at each word, first of each document at 0).

    Where a document has too few words before, the hash is of the words there are; such
    places are not looked up.
    """
    import zstandard

    texts = zstandard.decompress(packed) if sizes.sum() else b""
    buf, offsets = np.frombuffer(texts, np.uint8), np.concatenate([[0], np.cumsum(sizes)])
    hashes, counts = [], []
    for _, _, h, at in row_words(buf, offsets):
        hashes.append(h)
        counts.append(np.diff(at))
    h = np.concatenate(hashes) if hashes else np.zeros(0, U64)
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    drop_bits = U64(64 - HASH_BITS)
    out = [mix(h ^ U64(0x1F3D5B79)) >> drop_bits]
    acc = h
    for k in range(2, order + 1):
        prev = np.zeros_like(acc)
        prev[1:] = acc[:-1]
        acc = mix(prev * U64(0xA24BAED4963EE407) + h + U64(k))
        out.append(acc >> drop_bits)
    return n, out, (np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)


def _sorted(grams: list[np.ndarray], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every n-gram occurrence of a block, all orders, sorted; and which are the first of their n-gram."""
    keys = np.concatenate([g[place >= k] for k, g in enumerate(grams)])
    keys.sort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return keys, new


def _elsewhere(keys: np.ndarray, doc: np.ndarray, table: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Per occurrence of ``keys`` in ascending documents: the count in ``corpus`` less the document's own."""
    by = np.argsort(keys, kind="stable")  # so documents ascend within a key
    keys, doc = keys[by], doc[by]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    own = np.diff(first, append=len(keys))
    out = np.empty(len(keys), np.int64)
    out[by] = np.repeat(corpus[np.searchsorted(table, keys[first])] - own, own)
    return out


def pack(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as an Elias-Fano list: count, low bits, the low bits of all, the high parts as steps of a bit row."""
    n = len(keys)
    top = int(keys[-1]) + 1 if n else 1
    low = max(0, (top // max(1, n)).bit_length() - 1)
    bits = np.unpackbits(keys.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :low]
    high = (keys >> U64(low)).astype(np.int64) + np.arange(n)
    steps = np.zeros(int(high[-1]) + 1 if n else 0, np.uint8)
    steps[high] = 1
    return n.to_bytes(8, "little") + bytes([low]) + np.packbits(bits.ravel()).tobytes() + np.packbits(steps).tobytes()


def unpack(data: bytes) -> np.ndarray:
    n, low = int.from_bytes(data[:8], "little"), data[8]
    raw = np.frombuffer(data, np.uint8, offset=9)
    cut = -(-n * low // 8)
    bits = np.zeros((n, 64), np.uint8)
    bits[:, :low] = np.unpackbits(raw[:cut], count=n * low).reshape(n, low)
    steps = np.flatnonzero(np.unpackbits(raw[cut:]))[:n]
    high = (steps - np.arange(n)).astype(U64)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel().astype(U64) | (high << U64(low))


def pack_counts(n: np.ndarray) -> bytes:
    """One byte each; 255 stands for one of the 64-bit counts that follow."""
    small = np.minimum(n, 255).astype(np.uint8)
    return len(n).to_bytes(8, "little") + small.tobytes() + n[n >= 255].astype("<i8").tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    n = np.frombuffer(data, np.uint8, size, 8).astype(np.int64)
    n[n == 255] = np.frombuffer(data, "<i8", offset=8 + size)
    return n


def _ask(order: int, bits: int):
    def run(it):
        import pyarrow as pa

        for batch in it:
            block, sizes, texts = batches(batch, ["block", "sizes", "texts"])
            for k in range(len(block)):
                keys, new = _sorted(*_grams(texts[k].as_py(), np.array(sizes[k].as_py(), np.int64), order)[1:])
                counts = np.diff(np.flatnonzero(new), append=len(keys))
                keys = keys[new]
                edges = np.searchsorted(keys, np.arange((1 << bits) + 1, dtype=U64) << U64(HASH_BITS - bits))
                some = [b for b in range(1 << bits) if edges[b] < edges[b + 1]]
                base = lambda b: U64(b) << U64(HASH_BITS - bits)
                yield pa.record_batch(
                    [
                        pa.array(some, pa.int32()),
                        pa.array([block[k].as_py()] * len(some), pa.int64()),
                        pa.array([pack(keys[edges[b] : edges[b + 1]] - base(b)) for b in some], pa.binary()),
                        pa.array([pack_counts(counts[edges[b] : edges[b + 1]]) for b in some], pa.binary()),
                    ],
                    names=["bucket", "block", "keys", "counts"],
                )

    return run


def _merge(pdf: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    keys = [unpack(x) for x in pdf["keys"]]
    own = np.concatenate([unpack_counts(x) for x in pdf["counts"]])
    table, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(back, own, len(table)).astype(np.int64)
    return keys, table, back, total


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    keys, _, back, total = _merge(pdf)
    cuts = np.cumsum([0, *map(len, keys)])
    found = total[back]
    return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "counts": [pack_counts(found[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]})


def _table(pdf: pd.DataFrame) -> pd.DataFrame:
    _, table, _, total = _merge(pdf)
    return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "n": [len(table)], "keys": [pack(table)], "counts": [pack_counts(total)]})


def _ids(ids, nameless) -> pd.arrays.IntegerArray:
    gone = np.zeros(len(ids), bool)
    gone[np.asarray(nameless, np.int64)] = True
    return pd.arrays.IntegerArray(np.asarray(ids, np.int64), gone)


def _score(order: int, n_all: int):
    def run(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        answers = answers.sort_values("bucket")
        for ids, nameless, sizes, texts in zip(blocks["ids"], blocks["nameless"], blocks["sizes"], blocks["texts"]):
            n, grams, place = _grams(texts, np.asarray(sizes, np.int64), order)
            doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
            keys, new = _sorted(grams, place)
            table = keys[new]
            del keys, new
            corpus, at = np.empty(len(table), np.int64), 0
            for x in map(unpack_counts, answers["counts"]):
                corpus[at : at + len(x)] = x[: len(table) - at]
                at += len(x)
            if at != len(table):
                raise ValueError("a block and its answers differ")
            # an order at a time, so that a worker holds the occurrences of one
            c = s = np.zeros(0)
            for k in range(order):
                at = np.flatnonzero(place >= k)
                history, c = c, np.zeros(len(doc), np.int64)
                c[at] = _elsewhere(grams[k][at], doc[at], table, corpus)
                if not k:
                    s = np.log(np.maximum(c, UNSEEN)) - np.log(max(1, n_all))
                    continue
                # longer histories replace what they have seen
                seen = c[at] > 0
                s[at[~seen]] += np.log(ALPHA)
                at = at[seen]
                s[at] = np.log(c[at]) - np.log(np.maximum(history[at - 1], 1))
            total = np.bincount(doc, s, len(n))
            out.append(pd.DataFrame({"doc_id": _ids(ids, nameless), "n_words": n.astype(np.int64), "log_score": total, "mean_log_score": np.where(n > 0, total / np.maximum(n, 1), np.nan)}))
        return pd.concat(out) if out else pd.DataFrame({"doc_id": pd.array([], "Int64"), "n_words": np.zeros(0, np.int64), "log_score": np.zeros(0), "mean_log_score": np.zeros(0)})

    return run


def _asked(docs: DataFrame, order: int) -> tuple[DataFrame, DataFrame, int]:
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = save(base.mapInArrow(lean(_blocks), "block long, ids array<long>, nameless array<long>, sizes array<long>, texts binary, bytes long, words long"), "lm-blocks", row_group=ROW_GROUP)
    size = blocks.agg(F.sum("bytes")).first()[0] or 0
    parts = max(shuffle_partitions(docs.sparkSession), size // 6 * order // PER_PARTITION)
    bits = min(24, max(0, int(parts - 1).bit_length()))
    asked = blocks.select("block", "sizes", "texts").mapInArrow(lean(_ask(order, bits)), "bucket int, block long, keys binary, counts binary")
    return blocks, asked, parts


def count_tables(docs: DataFrame, order: int = 3) -> DataFrame:
    """The corpus counts of n-grams of all orders up to ``order``: bucket, n, packed keys, packed counts."""
    _, asked, _ = _asked(docs, order)
    return asked.groupBy("bucket").applyInPandas(lean_group(_table), "bucket int, n long, keys binary, counts binary")


def score_documents(docs: DataFrame, order: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, log_score, mean_log_score.

    ``log_score`` is the sum of ln S over the words (runs outside [\\x20\\x09-\\x0D], A-Z
    lower-cased); without words it is 0 and the mean is null.  Rows that repeat an id or
    a text are documents of their own, each counted.  Other columns are not read.
    """
    blocks, asked, _ = _asked(docs, order)
    answers = asked.groupBy("bucket").applyInPandas(lean_group(_answer), "block long, bucket int, counts binary")
    n_all = blocks.agg(F.sum("words")).first()[0] or 0
    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(lean_group(_score(order, n_all)), "doc_id long, n_words long, log_score double, mean_log_score double")
    return out.select("doc_id", "n_words", "log_score", F.when(F.col("n_words") > 0, F.col("mean_log_score")).alias("mean_log_score"))

