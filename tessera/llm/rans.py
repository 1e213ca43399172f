"""Static range asymmetric numeral system over token ids, vectorised across interleaved lanes.

A block holds ``steps`` rows of ``lanes`` ids; each lane is a 64-bit coder whose
states renormalise by 32-bit words into one stream.  One frequency table, scaled to
2^18, is shared by all blocks.  States stay below 2^52, so that a quotient of doubles is
the exact quotient: the state is below 2^34 frequencies, and a quotient that is not
whole is 2^-18 or more short of the next whole number.  A block is independent of every other one, carries a
checksum of its bytes and one of its ids, and has checkpoints (states and word
offset) at which a decoder may start: segments, blocks and checkpoints can all be
decoded in parallel.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BITS = 18
#: States lie in [2^LOW, 2^(LOW + 32)).
LOW = 20
LANES = 4096
BLOCK = 1 << 19
CHECKPOINT_STEPS = 64
MAGIC = b"TRNS"
_HEAD = struct.Struct("<IIIIII")  # ids, lanes, checkpoints, words, checksum of the ids, checksum of the body


def scale(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2^BITS, at least 1 for every id that occurs."""
    counts = np.asarray(counts, np.float64)
    seen = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if not len(seen):
        return out
    if len(seen) > 1 << BITS:
        raise ValueError("more ids than the table has room for")
    room = (1 << BITS) - len(seen)
    share = counts[seen] / counts.sum() * room
    out[seen] = 1 + np.floor(share).astype(np.int64)
    left = (1 << BITS) - int(out.sum())
    out[seen[np.argsort(-(share - np.floor(share)), kind="stable")[:left]]] += 1
    return out


class Table:
    """Frequencies and their running sums by id; by slot, for decoding, id, frequency and offset in one word."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]) if len(freq) else np.zeros(0, np.int64)
        self.packed = (self.freq << 32) | self.start
        self._slots: np.ndarray | None = None

    def slots(self) -> np.ndarray:
        if self._slots is None:
            ids = np.repeat(np.arange(len(self.freq)), self.freq)
            offset = np.arange(len(ids)) - self.start[ids]
            self._slots = (ids << 38) | ((self.freq[ids] - 1) << BITS) | offset
        return self._slots


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    n = len(ids)
    lanes = int(max(1, min(LANES, n // 64)))
    steps = -(-n // lanes)
    x = np.full(lanes, 1 << LOW, np.int64)
    words: list[np.ndarray] = [None] * steps  # type: ignore[list-item]
    marks: dict[int, np.ndarray] = {}
    both = table.packed[ids]
    freq, start = both >> 32, both & 0xFFFFFFFF
    limit = freq << (LOW + 32 - BITS)
    rest = (1 << BITS) - freq
    for t in range(steps - 1, -1, -1):
        a, b = t * lanes, min(n, (t + 1) * lanes)
        f, y = freq[a:b], x[: b - a]
        over = np.flatnonzero(y >= limit[a:b])
        emit = y[over]
        words[t] = (emit & 0xFFFFFFFF).astype(np.uint32)
        y[over] = emit >> 32
        q = (y / f).astype(np.int64)
        q *= rest[a:b]  # (q << BITS) + (y - q * f) + start
        q += y
        q += start[a:b]
        x[: b - a] = q
        if t and t % CHECKPOINT_STEPS == 0:
            marks[t] = x.copy()
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    stream = np.concatenate(words) if words else np.zeros(0, np.uint32)
    points = sorted(marks)
    body = x.astype("<i8").tobytes() + b"".join(struct.pack("<II", t, offsets[t]) + marks[t].astype("<i8").tobytes() for t in points) + stream.astype("<u4").tobytes()
    return _HEAD.pack(n, lanes, len(points), len(stream), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


def decode_block(data: memoryview, table: Table, checkpoint: int | None = None) -> np.ndarray:
    """The ids of a block; from its ``checkpoint``-th checkpoint on, if given."""
    n, lanes, points, n_words, ids_sum, body_sum = _HEAD.unpack_from(data)
    body = data[_HEAD.size :]
    if zlib.crc32(body) != body_sum:
        raise ValueError("a block's bytes do not match their checksum")
    point = 8 + 8 * lanes
    x = np.frombuffer(body, "<i8", lanes).astype(np.int64)
    stream = np.frombuffer(body, "<u4", n_words, 8 * lanes + points * point).astype(np.int64)
    t, at = 0, 0
    if checkpoint is not None:
        base = 8 * lanes + checkpoint * point
        t, at = struct.unpack_from("<II", body, base)
        x = np.frombuffer(body, "<i8", lanes, base + 8).astype(np.int64)
    first = t
    slots, low, mask = table.slots(), (1 << BITS) - 1, (1 << 20) - 1
    out = np.empty(n, np.uint32)
    for t in range(first, -(-n // lanes)):
        a, b = t * lanes, min(n, (t + 1) * lanes)
        y = x[: b - a]
        packed = slots[y & low]
        out[a:b] = packed >> 38
        y = (((packed >> BITS) & mask) + 1) * (y >> BITS) + (packed & low)
        under = np.flatnonzero(y < 1 << LOW)
        if len(under):
            y[under] = (y[under] << 32) | stream[at : at + len(under)]
            at += len(under)
        x[: b - a] = y
    out = out[first * lanes :]
    if not first and zlib.crc32(out.astype("<u4").tobytes()) != ids_sum:
        raise ValueError("a block's ids do not match their checksum")
    return out


def encode(ids: np.ndarray, table: Table) -> bytes:
    """A segment: directory of block sizes, then the blocks."""
    blocks = [encode_block(ids[i : i + BLOCK], table) for i in range(0, len(ids), BLOCK)]
    return MAGIC + struct.pack("<I", len(blocks)) + np.array([len(b) for b in blocks], "<u4").tobytes() + b"".join(blocks)


def decode(data: bytes, table: Table) -> np.ndarray:
    if data[:4] != MAGIC:
        raise ValueError("not a segment")
    (n,) = struct.unpack_from("<I", data, 4)
    sizes = np.frombuffer(data, "<u4", n, 8)
    view, at, out = memoryview(data), 8 + 4 * n, [np.zeros(0, np.uint32)]
    for size in sizes.tolist():
        out.append(decode_block(view[at : at + size], table))
        at += size
    return np.concatenate(out)
