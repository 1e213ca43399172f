"""Token ids of documents in binary files, coded by a static range asymmetric numeral system.

Texts are range-partitioned and sorted by doc_id, encoded once with the given
tokenizer, and gathered into segments of whole documents (about ``SEGMENT`` ids).  The
counts of all ids become the shared frequency table; every segment is then coded
independently and written, through Spark's committed writer, as one row of a Parquet
file: place in the order, first id's position, documents, lengths and coded blocks
(``rans``).  Reading decodes segment by segment.  What reaches the driver is the table
(bounded by the vocabulary) and one id count per partition.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from functools import cache as once

import numpy as np
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rans
from .common import REMEMBERED_BY, batches, drop, row_slices, save, scratch, shuffle_partitions, tidy

SEGMENT = 1 << 19
#: Distinct chunks a worker remembers; above that it forgets those not met for the longest time.
REMEMBERED = 1_000_000
ROW_GROUP = 16 << 20
#: Bytes of the texts that are encoded together (one text, if it is longer).
ENCODED_AT_ONCE = 4 << 20


@once
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if visible in Latin-1, else the next from U+0100."""
    letters, spare = [], 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            letters.append(chr(byte))
        else:
            letters.append(chr(spare))
            spare += 1
    return letters


_LETTERS = {i: c for i, c in enumerate(_byte_letters())}
#: The word pattern of byte-level BPE vocabularies of this family (a fixed value).
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_LATIN = "\u024f"
_SPACE = _LETTERS[ord(" ")]
_MARKS = string.punctuation
#: Before a line's first chunk, in texts that do not hold it themselves.
_LINE = "\0"


class _Pieces(dict):
    """Piece of a text -> bytes of its ids, by the library's own merge model."""

    def __init__(self, tokenizer, dtype: str):
        self.model, self.dtype = tokenizer.model, dtype

    def __missing__(self, piece: str) -> bytes:
        letters = piece.encode().decode("latin-1").translate(_LETTERS)
        ids = self[piece] = np.array([t.id for t in self.model.tokenize(letters)], self.dtype).tobytes()
        return ids


class _Chunks(dict):
    """Chunk between spaces -> bytes of the ids of " " + chunk; after _LINE, of a line break and the chunk."""

    def __init__(self, tokenizer, dtype: str):
        self.tokenizer, self.dtype, self.pieces = tokenizer, dtype, _Pieces(tokenizer, dtype)
        self.bytes_of = [i.to_bytes(np.dtype(dtype).itemsize, "little") for i in range(max(tokenizer.get_vocab().values(), default=-1) + 1)]
        self.former: dict[str, bytes] = {}

    def age(self) -> None:
        """Forget what was not met since the last time."""
        self.former = dict(self)
        self.clear()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.former.get(chunk)
        if ids is None:
            if chunk.isalpha() and (chunk.isascii() or max(chunk) <= _LATIN):
                letters = _SPACE + chunk if chunk.isascii() else (" " + chunk).encode().decode("latin-1").translate(_LETTERS)
                ids = b"".join([self.bytes_of[t.id] for t in self.pieces.model.tokenize(letters)])
            elif chunk[:1] == _LINE:
                ids = self.pieces["\n"] + self._start(chunk[1:])
            elif "\n" in chunk and self._apart(lines := chunk.split("\n")):  # seldom met again: not remembered
                return self[lines[0]] + b"".join([self.pieces["\n"] + self._start(line) for line in lines[1:]])
            else:
                head = chunk.rstrip(_MARKS)
                if len(head) < len(chunk) and self._word(head):  # a word and marks are two pieces
                    ids = self[head] + self.pieces[chunk[len(head) :]]
                else:
                    ids = self.of(" " + chunk)
        self[chunk] = ids
        return ids

    @staticmethod
    def _word(text: str) -> bool:
        return text.isalpha() and (text.isascii() or max(text) <= _LATIN)

    @staticmethod
    def _apart(lines: list[str]) -> bool:
        """Whether each line break stands alone between visible characters: then it is a piece of its own."""
        for line in lines:
            if not line or line[0].isspace() or line[-1].isspace() or not (line.isascii() or max(line) <= _LATIN):
                return False
        return True

    def _start(self, line: str) -> bytes:
        head = line.rstrip(_MARKS)
        if not self._word(head):
            return self.of(line)
        return self.pieces[head] + self.pieces[line[len(head) :]] if len(head) < len(line) else self.pieces[head]

    def of(self, text: str) -> bytes:
        if text and max(text) > _LATIN:  # leave the classes of other scripts to the library
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text)))


def _lines_apart(text: str) -> str:
    """The text with a space and _LINE for its line breaks, if each stands alone between visible characters: then it is a piece of its own."""
    if "\n" not in text:
        return text
    lines = text.split("\n")
    for line in lines:
        if not line or line[0].isspace() or line[-1].isspace():
            return text
    return f" {_LINE}".join(lines)


class ChunkEncoder:
    """Encodes texts by their chunks between spaces, each distinct chunk once.

    A byte-level BPE with the usual word pattern never merges across a single space
    that stands between two other characters, and the space belongs to what follows.
    So a text is its first chunk and then " " + chunk, unless spaces meet; such texts are
    encoded whole, and so are texts that hold the string of an added token.  ``fast`` is off for vocabularies of another kind: then every text is.
    """

    def __init__(self, path: str, dtype: str):
        self.tokenizer, self.dtype = _tokenizer(path), dtype
        added = self.tokenizer.get_added_tokens_decoder().values()
        names = [regex.escape(t.content) for t in added if t.content]
        self.added = regex.compile("|".join(names)) if names else None
        self.known = _Chunks(self.tokenizer, dtype)
        probe = "It's 12 naïve\n\n tests, wasn't they? "
        self.fast = self._whole([probe])[0] == self._probe(probe)
        if self.tokenizer.normalizer is not None and any(t.normalized for t in added):  # may stand in a text in another form
            self.fast = False

    def _probe(self, text: str) -> bytes | None:
        try:
            return self.known.of(text)
        except Exception:  # a model that does not know byte letters
            return None

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.fast:
            return self._whole(texts)
        out, whole, plain = [b""] * len(texts), [], []
        for i, text in enumerate(texts):
            apart = "  " in text or text[:1] == " " or text[-1:] == " " or _LINE in text or (self.added and self.added.search(text))
            (whole if apart else plain).append(i)
        for i, ids in zip(whole, self._whole([texts[i] for i in whole]) if whole else ()):
            out[i] = ids
        for i, ids in zip(plain, self._by_chunks([texts[i] for i in plain]) if plain else ()):
            out[i] = ids
        return out

    def _by_chunks(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of texts without spaces that meet; each distinct chunk of theirs is looked up once."""
        import pyarrow as pa
        import pyarrow.compute as pc

        known = self.known
        if len(known) > REMEMBERED // 2:
            known.age()
        if len(known.pieces) > REMEMBERED // 2:
            known.pieces.clear()
        chunks = pc.split_pattern(pa.array(texts := [*map(_lines_apart, texts)], pa.large_string()), " ")
        at = np.asarray(chunks.offsets)
        # a text's first chunk has no space before it
        rest = np.ones(int(at[-1]), bool)
        rest[at[:-1]] = False
        rest = chunks.values.filter(pa.array(rest)).dictionary_encode()
        # one more, so that the array is of objects even without chunks
        ids = np.array([*map(known.__getitem__, rest.dictionary.to_numpy(zero_copy_only=False)), None], object)[np.asarray(rest.indices)]
        at = (at - np.arange(len(at))).tolist()
        for text, a, b in zip(texts, at, at[1:]):
            yield known.of(text.partition(" ")[0]) + b"".join(ids[a:b].tolist())


@once
def _coder(path: str, dtype: str) -> ChunkEncoder:
    """A worker's encoder: what it remembers serves all its tasks."""
    return ChunkEncoder(path, dtype)


REMEMBERED_BY["token_files"] = [_coder.cache_clear, _tokenizer.cache_clear]


def _segments(path: str, dtype: str, end_id: int, vocab: int):
    """Segments of a task's documents; the last one has the counts of all ids of the task."""
    width = np.dtype(dtype).itemsize

    def run(it):
        import pyarrow as pa
        import pyarrow.compute as pc

        coder = _coder(path, dtype)
        end = np.array([end_id], dtype).tobytes()
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        lens: list[int] = []
        held: list[bytes] = []
        size = 0
        total = np.zeros(vocab, np.int64)

        def out(last: bool = False):
            ids = b"".join(held)
            np.add(total, np.bincount(np.frombuffer(ids, dtype), minlength=vocab), out=total)
            return pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int64())), pa.array([ids], pa.binary()), pa.array([total.astype("<i8").tobytes() if last else None], pa.binary())],
                names=["part", "seq", "before", "n_ids", "docs", "lens", "ids", "counts"],
            )

        for batch in it:
            ids, texts = batches(batch, ["doc_id", "text"])
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            for i, j in row_slices(np.append(0, ends), ENCODED_AT_ONCE):
                some = [t or "" for t in texts.slice(i, j - i).to_pylist()]
                for doc, coded in zip(ids.slice(i, j - i).to_pylist(), coder.encode(some)):
                    docs.append(doc)
                    held.append(coded + end)
                    lens.append(len(coded) // width + 1)
                    size += lens[-1]
                    if size >= SEGMENT:
                        yield out()
                        seq, before = seq + 1, before + size
                        docs, lens, held, size = [], [], [], 0
        if docs or seq:
            yield out(last=True)
        tidy()

    return run


def _histogram(vocab: int):
    def run(it):
        import pyarrow as pa

        total = np.zeros(vocab, np.int64)
        for batch in it:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), "<i8")
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    return run


_FILE = "part int, seq int, start long, n_ids long, docs array<long>, lens array<long>, coded binary"


def _encode(dtype: str, freq: np.ndarray, offsets: dict[int, int]):
    def run(it):
        import pyarrow as pa

        table = rans.Table(freq)
        for batch in it:
            part, seq, before, n_ids, docs, lens, ids = batches(batch, ["part", "seq", "before", "n_ids", "docs", "lens", "ids"])
            for k in range(len(part)):
                coded = rans.encode(np.frombuffer(ids[k].as_buffer(), dtype), table)
                start = offsets[part[k].as_py()] + before[k].as_py()
                yield pa.record_batch([part.slice(k, 1), seq.slice(k, 1), pa.array([start], pa.int64()), n_ids.slice(k, 1), docs.slice(k, 1), lens.slice(k, 1), pa.array([coded], pa.binary())], names=["part", "seq", "start", "n_ids", "docs", "lens", "coded"])

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, out_path: str, end_id: int = 0) -> None:
    """Encode ``docs`` (doc_id, text) into ``out_path``/segments and ``out_path``/table.

    Each text's ids are followed by ``end_id``; null text is empty.  Documents stand in
    ascending doc_id order (null first; rows that repeat an id by text).  The
    library's defaults hold, so strings of special tokens become those tokens.
    """
    spark = docs.sparkSession
    vocab = max(_tokenizer(tokenizer_path).get_vocab_size(), end_id + 1)
    dtype = "<u2" if vocab <= 1 << 16 else "<u4"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    spec = "part int, seq int, before long, n_ids long, docs array<long>, lens array<long>, ids binary, counts binary"
    ids = save(rows.mapInArrow(_segments(tokenizer_path, dtype, end_id, vocab), spec), "token-ids", row_group=ROW_GROUP)
    counts = ids.where("counts is not null").select("counts").mapInArrow(_histogram(vocab), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    total = np.zeros(vocab, np.int64)
    for id_, n in counts.collect():  # at most the vocabulary
        total[id_] = n
    freq = rans.scale(total)
    offsets, at = {}, 0
    for part, n in ids.groupBy("part").agg(F.sum("n_ids")).orderBy("part").collect():  # one row per partition
        offsets[part], at = at, at + n
    files = ids.drop("counts").mapInArrow(_encode(dtype, freq, offsets), _FILE)
    files.write.option("compression", "none").option("parquet.block.size", ROW_GROUP).parquet(f"{out_path}/segments")
    spark.createDataFrame([(rans.BITS, freq.astype("<u4").tobytes())], "bits int, freq binary").coalesce(1).write.parquet(f"{out_path}/table")
    drop(ids)


def _decode(freq: np.ndarray, whole: bool):
    def run(it):
        import pyarrow as pa

        table = rans.Table(freq)
        for batch in it:
            start, docs, lens, coded = batches(batch, ["start", "docs", "lens", "coded"])
            for k in range(len(start)):
                ids = rans.decode(coded[k].as_py(), table).astype("<u4")
                sizes = np.array(lens[k].as_py(), np.int64)
                ends = np.cumsum(sizes)
                raw = memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), sizes.tolist())]
                columns = [docs[k].values, pa.array(start[k].as_py() + ends - sizes, pa.int64()), pa.array(sizes), pa.array(sums, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if whole:
                    columns.append(pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(ids, pa.int64())))
                    names.append("ids")
                yield pa.record_batch(columns, names=names)

    return run


def read_token_files(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and the ids) per document, decoded from the files."""
    row = spark.read.parquet(f"{path}/table").first()
    if row["bits"] != rans.BITS:
        raise ValueError("another table size")
    freq = np.frombuffer(row["freq"], "<u4").astype(np.int64)
    spec = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")
    segments = spark.read.schema(_FILE).parquet(f"{path}/segments")
    return segments.select("start", "docs", "lens", "coded").mapInArrow(_decode(freq, ids), spec)


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and describe each document from them.

    One row per row of ``docs``: doc_id, start, n_tokens, ids_crc32.  An empty table gives
    empty files and no rows.
    """
    path = scratch(docs.sparkSession, "token-files")
    write_token_files(docs, tokenizer_path, path, end_id)
    return read_token_files(docs.sparkSession, path)
