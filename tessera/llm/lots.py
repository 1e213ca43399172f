"""How often tokens occur, asked and answered in packed messages.

A *lot* is a run of rows with about ``LOT`` tokens in all (one row, if it is longer).
Each lot sends every bucket (token modulo the number of buckets) one message with its
distinct tokens there, and each bucket answers the lots.  So a token goes over the
network once per lot, however many rows hold it: a token of very many rows makes no hot
key, and a message row carries hundreds of tokens.  A task holds one bucket or one lot.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, lean_group, shuffle_partitions

#: Tokens of a lot, and of a bucket on average at most.
LOT, BUCKET = 1 << 17, 1 << 20


def lot_ids() -> Callable[[int], int]:
    """Called with the token counts of a task's rows in turn: the lot of each."""
    from pyspark import TaskContext

    task, lot, held = TaskContext.get().partitionId() << 32, 0, 0

    def of(tokens: int) -> int:
        nonlocal lot, held
        if held and held + tokens > LOT:
            lot, held = lot + 1, 0
        held += tokens
        return task + lot

    return of


def _buckets(rows: DataFrame, tokens: str) -> int:
    total = rows.agg(F.sum(F.size(tokens).cast("long"))).first()[0] or 0
    return max(2 * shuffle_partitions(rows.sparkSession), math.ceil(total / BUCKET))


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Values (unsigned) and offsets of an Arrow list column."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.asarray(column.offsets).astype(np.int64)
    return np.asarray(column.values)[at[0] : at[-1]].view(np.uint64), at - at[0]


def _runs(sorted_tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of equal values."""
    first = np.flatnonzero(np.r_[True, sorted_tokens[1:] != sorted_tokens[:-1]]) if len(sorted_tokens) else np.zeros(0, np.int64)
    return first, np.diff(np.r_[first, len(sorted_tokens)])


def _deal(lot: int, tokens: np.ndarray, note: np.ndarray, n: int):
    """Messages to the buckets: bucket, lot, tokens, a 32-bit note per token."""
    to = (tokens % np.uint64(n)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    at = np.searchsorted(to[order], np.arange(n + 1))
    tokens, note = tokens[order], note[order].astype(np.int32)
    for b in np.flatnonzero(np.diff(at)):
        yield int(b), lot, tokens[at[b] : at[b + 1]].tobytes(), note[at[b] : at[b + 1]].tobytes()


def _messages(rows, names: list[str], types: list):
    import pyarrow as pa

    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, bytes)) + 64
        if size > 1 << 22:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def _joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)


# -- rows that share enough of their tokens ----------------------------------------------


def _ask_shared(n: int):
    def lots(it):
        rows, need, parts, held, of, last = [], [], [], 0, lot_ids(), None
        for batch in it:
            values, at = _lists(batch.column(batch.schema.get_field_index("prefix")))
            ids = np.asarray(batch.column(batch.schema.get_field_index("row")))
            longest = np.asarray(batch.column(batch.schema.get_field_index("longest")))
            for k in range(len(ids)):
                lot = of(int(at[k + 1] - at[k]))
                if rows and lot != last:
                    yield last, rows, need, parts
                    rows, need, parts = [], [], []
                last = lot
                rows.append(ids[k])
                need.append(longest[k])
                parts.append(values[at[k] : at[k + 1]])
        if rows:
            yield last, rows, need, parts

    def messages(it):
        for lot, rows, need, parts in lots(it):
            tokens = np.concatenate(parts)
            row = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
            order = np.argsort(tokens, kind="stable")
            tokens, row = tokens[order], row[order]
            first, count = _runs(tokens)
            known = np.bincount(row[np.repeat(count > 1, count)], minlength=len(rows))
            yield lot % n, lot, None, None, np.array(rows, np.int64).tobytes(), (np.array(need) - known).astype(np.int32).tobytes()
            for m in _deal(lot, tokens[first], np.where(count > 1, -1, row[first]), n):
                yield *m, None, None

    def run(it):
        import pyarrow as pa

        yield from _messages(messages(it), ["bucket", "lot", "tokens", "note", "rows", "need"], [pa.int32(), pa.int64(), *[pa.binary()] * 4])

    return run


def _answer_shared(table):
    """Passes on what a lot says of its rows; to each message, the rows whose token another lot holds."""
    import pyarrow as pa

    lot, tokens, note, rows, need = (table.column(c) for c in ("lot", "tokens", "note", "rows", "need"))
    sizes = [len(x) // 8 if x else 0 for x in tokens.to_pylist()]
    values, notes = _joined(tokens, np.uint64), _joined(note, np.int32)
    order = np.argsort(values, kind="stable")
    first, count = _runs(values[order])
    several = np.zeros(len(values), bool)
    several[order] = np.repeat(count > 1, count)
    several &= notes >= 0
    ends = np.cumsum([0, *sizes])
    found = [notes[a:b][several[a:b]].tobytes() for a, b in zip(ends[:-1], ends[1:])]
    return pa.table({"lot": lot, "rows": rows, "need": need, "found": pa.array(found, pa.binary())})


def _rows_kept(table):
    import pyarrow as pa

    rows, need = _joined(table.column("rows"), np.int64), _joined(table.column("need"), np.int32)
    found = np.bincount(_joined(table.column("found"), np.int32), minlength=len(rows))
    return pa.table({"row": pa.array(rows[found >= need], pa.int64())})


def rows_with_shared(rows: DataFrame) -> DataFrame:
    """Of rows (row, longest, prefix), the ids of those with ``longest`` or more distinct tokens that other rows hold."""
    n = _buckets(rows, "prefix")
    asked = rows.select("row", "longest", "prefix").mapInArrow(lean(_ask_shared(n)), "bucket int, lot long, tokens binary, note binary, rows binary, need binary")
    answers = asked.groupBy("bucket").applyInArrow(lean_group(_answer_shared), "lot long, rows binary, need binary, found binary")
    answers = answers.where("rows is not null or length(found) > 0")
    return answers.groupBy("lot").applyInArrow(lean_group(_rows_kept), "row long")


# -- frequencies of the tokens of whole sets ---------------------------------------------


def _ask_frequencies(n: int):
    def lots(it):
        last, parts = None, []
        for batch in it:
            values, at = _lists(batch.column(batch.schema.get_field_index("tokens")))
            ids = np.asarray(batch.column(batch.schema.get_field_index("lot")))
            for k in range(len(ids)):
                if parts and ids[k] != last:
                    yield last, parts
                    parts = []
                last = int(ids[k])
                parts.append(values[at[k] : at[k + 1]])
        if parts:
            yield last, parts

    def messages(it):
        for lot, parts in lots(it):
            tokens, count = np.unique(np.concatenate(parts), return_counts=True)
            yield from _deal(lot, tokens, count, n)

    def run(it):
        import pyarrow as pa

        yield from _messages(messages(it), ["bucket", "lot", "tokens", "note"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()])

    return run


def _answer_frequencies(table):
    """To each message, its tokens that two rows hold at least, with their frequencies."""
    import pyarrow as pa

    sizes = [len(x) // 8 for x in table.column("tokens").to_pylist()]
    values = _joined(table.column("tokens"), np.uint64)
    which, place = np.unique(values, return_inverse=True)
    df = np.bincount(place, _joined(table.column("note"), np.int32), len(which)).astype(np.int64)[place]
    ends = np.cumsum([0, *sizes])
    tokens = [values[a:b][df[a:b] > 1].tobytes() for a, b in zip(ends[:-1], ends[1:])]
    counts = [df[a:b][df[a:b] > 1].tobytes() for a, b in zip(ends[:-1], ends[1:])]
    return pa.table({"lot": table.column("lot"), "shared": pa.array(tokens, pa.binary()), "df": pa.array(counts, pa.binary())})


def _postings(choose):
    def run(sets, answers):
        import pyarrow as pa

        out = {"token": [], "id": [], "n": [], "u": [], "l": [], "o": []}
        if sets.num_rows:
            shared, where = np.unique(_joined(answers.column("shared"), np.uint64), return_index=True)
            df = _joined(answers.column("df"), np.int64)[where]
            values, at = _lists(sets.column("tokens"))
            for k, (i, n) in enumerate(zip(sets.column("id").to_pylist(), sets.column("n").to_pylist())):
                tokens = values[at[k] : at[k + 1]]
                place = np.searchsorted(shared, tokens)
                held = place < len(shared)
                held[held] = shared[place[held]] == tokens[held]
                chosen = choose(n, tokens[held].view(np.int64), df[place[held]]) if held.any() else None
                if chosen:
                    prefix, u, length, own = chosen
                    for name, x in (("token", prefix), ("id", np.full(len(prefix), i)), ("n", np.full(len(prefix), n)), ("u", np.full(len(prefix), u)), ("l", np.full(len(prefix), length)), ("o", np.full(len(prefix), own))):
                        out[name].append(x)
        return pa.table({c: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for c, x in out.items()})

    return run


def frequencies(sets: DataFrame, choose: Callable) -> DataFrame:
    """Postings token, id, n, u, l, o of the prefixes that ``choose(n, shared tokens, their frequencies)`` takes of rows id, n, lot, tokens."""
    asked = sets.select("lot", "tokens").mapInArrow(lean(_ask_frequencies(_buckets(sets, "tokens"))), "bucket int, lot long, tokens binary, note binary")
    answers = asked.groupBy("bucket").applyInArrow(lean_group(_answer_frequencies), "lot long, shared binary, df binary").where("length(shared) > 0")
    both = sets.select("lot", "id", "n", "tokens").groupBy("lot").cogroup(answers.groupBy("lot"))
    return both.applyInArrow(lean_group(_postings(choose)), "token long, id long, n long, u long, l long, o long")
