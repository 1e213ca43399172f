"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are folded (A-Z lower-cased, each run of white space one space).  If a region of a
document is within k edits of an item of m bytes, the two share at least
``m - q + 1 - k q`` of the item's q-grams, and the diagonals (place in the document less
place in the item) of those grams lie within k of one another.  So shared q-grams are
counted in bands of diagonals that overlap by the largest k; a band that reaches the
item's bound is kept and verified by banded alignment of the whole item.  Grams are
``Q`` bytes long, shorter for items whose bound would else not be above 0, so every item
keeps its whole budget.  An occurrence holds one at least of an item's rarest grams (all
but bound - 1 of them); only these find (document, item) pairs, so openings that many items
share cost nothing, and the other grams are counted pair by pair, in slices of the text
where they are many.  The grams of the items are an index of bounded size: larger
benchmarks are taken in blocks, each of which sees all documents.  Documents never leave their task, so neither copies nor
a passage that many documents share make a hot group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, U64, batches, gram_hashes, lean, row_slices, save, utf8

Q = 12
#: Edits allowed per byte of an item.
RATE = 0.05
#: Bytes of items in one index.
BLOCK_BYTES = 8 << 20
#: Bytes of text scanned at a time; the matches are the same whatever it is.
WINDOW = 1 << 18
#: Pairs of places that are looked at together.
SLICE = 1 << 20


def _match_type():
    import pyarrow as pa

    return pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])


def fold(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes and the source place of each."""
    space = SPACE[buf]
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    if len(buf):
        keep[0] = True
    place = np.flatnonzero(keep)
    out = LOWER[buf[place]]
    out[space[place]] = 32
    return out, place


def edits(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """Least edits that turn ``item`` into a substring of ``text``, and that substring's end.

    Only cells with diagonal (text place - item place) in [low, high] are used; the
    substring may start and end anywhere.
    """
    m, width = len(item), high - low + 1
    big = m + len(text) + 1
    step = np.arange(width)
    at = step + low  # text prefix length in row 0
    row = np.where((at >= 0) & (at <= len(text)), 0, big)
    pad = np.full(width + 1, big)
    for i in range(1, m + 1):
        place = step + low + i  # text prefix length
        inside = (place >= 1) & (place <= len(text))
        same = np.ones(width, np.int64)
        ok = np.flatnonzero(inside)
        same[ok] = text[place[ok] - 1] != item[i - 1]
        pad[:width] = row
        new = np.minimum(np.where(inside, row + same, big), pad[1:] + 1)
        new[(place < 0) | (place > len(text))] = big
        row = np.minimum.accumulate(new - step) + step  # runs of insertions
        row[(place < 0) | (place > len(text))] = big
    best = int(np.argmin(row))
    return int(row[best]), best + low + m


class Grams:
    """The q-grams of items with the same q: (item number, folded bytes, edits k)."""

    def __init__(self, q: int, items: list[tuple[int, np.ndarray, int]]):
        self.q, self.n = q, len(items)
        self.numbers = np.array([i for i, _, _ in items])
        self.lengths = [len(t) for _, t, _ in items]
        self.k_most = max(k for _, _, k in items)
        self.step = 4 * (self.k_most + 1)
        hashes = [gram_hashes(t, q) for _, t, _ in items]
        self.grams, back = np.unique(np.concatenate(hashes), return_inverse=True)
        cuts = np.cumsum([0, *map(len, hashes)])
        # per item: its distinct grams and their places
        self.own, self.places, self.bound = [], [], []
        for k, (_, _, edits_) in enumerate(items):
            g = back[cuts[k] : cuts[k + 1]]
            order = np.argsort(g, kind="stable")
            own, first = np.unique(g[order], return_index=True)
            self.own.append(own)
            self.places.append(np.split(order, first[1:]))
            # a gram that the item repeats is counted once
            self.bound.append(max(1, len(own) - edits_ * q))
        holders = np.bincount(np.concatenate(self.own), minlength=len(self.grams))
        seed_gram, seed_item = [], []
        for k, own in enumerate(self.own):
            rare = own[np.lexsort((own, holders[own]))][: len(own) - self.bound[k] + 1]
            seed_gram.append(rare)
            seed_item.append(np.full(len(rare), k))
        seed_gram, seed_item = np.concatenate(seed_gram), np.concatenate(seed_item)
        order = np.argsort(seed_gram, kind="stable")
        self.seed_item = seed_item[order]
        self.seed_at = np.searchsorted(seed_gram[order], np.arange(len(self.grams) + 1))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.grams & U64((1 << 20) - 1)).astype(np.int64)] = True

    def _hits(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in text, number of the gram) of every gram of the items, text read in windows."""
        spots, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, max(1, len(text) - self.q + 1), WINDOW):
            h = gram_hashes(text[a : a + WINDOW + self.q - 1], self.q)
            some = np.flatnonzero(self.seen[(h & U64((1 << 20) - 1)).astype(np.int64)])
            if not len(some):
                continue
            g = np.minimum(np.searchsorted(self.grams, h[some]), len(self.grams) - 1)
            real = self.grams[g] == h[some]
            spots.append(some[real] + a)
            at.append(g[real])
        return np.concatenate(spots), np.concatenate(at)

    def _pairs(self, doc: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """document * n + item of the pairs that share a rare gram, ascending."""
        n = self.seed_at[gram + 1] - self.seed_at[gram]
        doc, gram, n = doc[n > 0], gram[n > 0], n[n > 0]
        if not len(doc):
            return np.zeros(0, np.int64)
        # a gram of a document is asked once
        _, first = np.unique(doc * len(self.grams) + gram, return_index=True)
        doc, gram, n = doc[first], gram[first], n[first]
        found, ends, a = [], np.cumsum(n), 0
        while a < len(n):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] - n[a] + SLICE, "right")))
            which = np.repeat(self.seed_at[gram[a:b]], n[a:b]) + np.arange(n[a:b].sum()) - np.repeat(ends[a:b] - n[a:b] - (ends[a] - n[a]), n[a:b])
            found.append(np.unique(np.repeat(doc[a:b], n[a:b]) * self.n + self.seed_item[which]))
            a = b
        return np.unique(np.concatenate(found))

    def _bands(self, item: int, spot: np.ndarray, gram: np.ndarray):
        """(low, high) of the bands of diagonals of one document that reach the bound; grams sorted, with their spots."""
        own, places, bound = self.own[item], self.places[item], self.bound[item]
        left, right = np.searchsorted(gram, own, "left"), np.searchsorted(gram, own, "right")
        here = np.flatnonzero(right > left)
        if len(here) < bound:
            return
        total = int(sum((right[g] - left[g]) * len(places[g]) for g in here))
        if total > SLICE:  # in halves of the text, which overlap by more than an occurrence
            low, high = int(spot.min()), int(spot.max())
            over = self.lengths[item] + 2 * self.k_most + 2 * self.step
            if high - low > 4 * over:
                middle = (low + high) // 2
                for part in (spot < middle + over, spot >= middle):
                    yield from self._bands(item, spot[part], gram[part])
                return
        at = np.concatenate([np.repeat(spot[left[g] : right[g]], len(places[g])) for g in here])
        place = np.concatenate([np.tile(places[g], right[g] - left[g]) for g in here])
        kind = np.concatenate([np.full((right[g] - left[g]) * len(places[g]), g) for g in here])
        diagonal = at - place
        band = diagonal // self.step
        again = diagonal - band * self.step < self.k_most  # also of the band below, which overlaps this one
        band = np.concatenate([band, band[again] - 1])
        kind, diagonal = np.concatenate([kind, kind[again]]), np.concatenate([diagonal, diagonal[again]])
        order = np.lexsort((kind, band))
        band, kind, diagonal = band[order], kind[order], diagonal[order]
        new = np.ones(len(band), bool)
        new[1:] = band[1:] != band[:-1]
        first = np.flatnonzero(new)
        distinct = new.copy()
        distinct[1:] |= kind[1:] != kind[:-1]
        counts = np.add.reduceat(distinct.astype(np.int64), first)
        low, high = np.minimum.reduceat(diagonal, first), np.maximum.reduceat(diagonal, first)
        for k in np.flatnonzero(counts >= bound):
            yield int(low[k]), int(high[k])

    def regions(self, text: np.ndarray, starts: np.ndarray):
        """(document, item number, low, high) of bands that reach their item's bound; documents begin at ``starts``."""
        spot, gram = self._hits(text)
        doc = np.searchsorted(starts, spot, "right") - 1
        ends = np.append(starts[1:], len(text))
        whole = spot + self.q <= ends[doc]  # a gram across two documents is none
        spot, gram, doc = spot[whole], gram[whole], doc[whole]
        pairs = self._pairs(doc, gram)
        if not len(pairs):
            return
        order = np.lexsort((spot, gram, doc))
        spot, gram, doc = spot[order], gram[order], doc[order]
        for d in np.unique(pairs // self.n).tolist():
            a, b = np.searchsorted(doc, [d, d + 1])
            for pair in pairs[np.searchsorted(pairs, d * self.n) : np.searchsorted(pairs, (d + 1) * self.n)].tolist():
                item = pair - d * self.n
                for low, high in self._bands(item, spot[a:b] - starts[d], gram[a:b]):
                    yield d, int(self.numbers[item]), low, high


class Index:
    """The items of a block by the length of their grams; items without edits that are shorter than q are sought as they are."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = RATE):
        if not 0 <= rate < 1:
            raise ValueError("rate is a share of an item's bytes")
        self.short: list[tuple[int, bytes]] = []
        self.ids, self.texts, self.k = [], [], []
        by: dict[int, list[tuple[int, np.ndarray, int]]] = {}
        for item, text in items:
            folded = fold(np.frombuffer((text or "").strip().encode(), np.uint8))[0]
            m = len(folded)
            if not m:
                continue
            k = int(rate * m)
            if not k and m < q:
                self.short.append((item, folded.tobytes()))
                continue
            # the bound m - size + 1 - k size is above 0
            size = min(q, m // (k + 1))
            by.setdefault(size, []).append((len(self.ids), folded, k))
            self.ids.append(item)
            self.texts.append(folded)
            self.k.append(k)
        self.parts = [Grams(size, some) for size, some in sorted(by.items())]

    def regions(self, text: np.ndarray, starts: np.ndarray):
        for part in self.parts:
            yield from part.regions(text, starts)

    def verify(self, text: np.ndarray, item: int, low: int, high: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of an occurrence in a document's folded text, if within the item's budget."""
        want, k = self.texts[item], self.k[item]
        a, b = max(0, low - k), min(len(text), high + len(want) + k)
        at = text[a:b].tobytes().find(want.tobytes())
        if at >= 0:
            return 0, a + at, a + at + len(want)
        part = text[a:b]
        n, end = edits(want, part, low - k - a, high + k - a)
        if n > k:
            return None
        back = part[:end][::-1]
        # place - item place of the reversed strings: end - m - diagonal
        _, begin = edits(want[::-1], back, end - len(want) - (high + k - a), end - len(want) - (low - k - a))
        return n, a + end - begin, a + end


def _scan(index: Index):
    def run(it):
        import pyarrow as pa

        for batch in it:
            ids, texts = batches(batch, ["row", "text"])
            buf, offsets = utf8(texts)
            rows, items, cost, start, end = [], [], [], [], []
            for i, j in row_slices(offsets, WINDOW):
                source = buf[offsets[i] : offsets[j]]
                folded, place = fold(source)
                # white space that a row begins with is its own, whatever row stood before
                at = np.searchsorted(place, offsets[i:j] - offsets[i])
                stops = np.append(at[1:], len(folded))
                found: dict[tuple[int, int], tuple[int, int, int]] = {}
                for doc, item, low, high in index.regions(folded, at):
                    if (best := found.get((doc, item))) and not best[0] and best[1] <= low:
                        continue  # an exact occurrence further ahead
                    hit = index.verify(folded[at[doc] : stops[doc]], item, low, high)
                    if hit and (found.get((doc, item)) is None or hit < found[doc, item]):
                        found[doc, item] = hit
                raw = folded.tobytes() if index.short else b""
                for item, want in index.short:
                    x = raw.find(want)
                    while x >= 0:
                        doc = int(np.searchsorted(at, x, "right")) - 1
                        if x + len(want) <= stops[doc]:
                            found.setdefault((doc, -1 - item), (0, x - at[doc], x - at[doc] + len(want)))
                        x = raw.find(want, x + 1)
                if found:
                    lead = np.concatenate([[0], np.cumsum((source & 0xC0) != 0x80)])  # code points before each byte
                    for (doc, item), (n, a, b) in found.items():
                        base = offsets[i + doc] - offsets[i]
                        x, y = place[at[doc] + a], place[at[doc] + b - 1] + 1
                        rows.append(ids[i + doc].as_py())
                        items.append(index.ids[item] if item >= 0 else -1 - item)
                        cost.append(n)
                        start.append(int(lead[x] - lead[base]))
                        end.append(int(lead[y] - lead[base]))
            yield pa.record_batch([pa.array(x, t) for x, t in ((rows, pa.int64()), (items, pa.int64()), (cost, pa.int32()), (start, pa.int64()), (end, pa.int64()))], names=["row", "item_id", "edits", "start", "end"])

    return run


def _rows(index: Index):
    """Per row of a batch (doc_id, text): its matches, from one pass over the text."""
    scan = _scan(index)

    def run(it):
        import pyarrow as pa

        for batch in it:
            ids, texts = batches(batch, ["doc_id", "text"])
            numbered = pa.record_batch([pa.array(range(len(ids)), pa.int64()), texts], names=["row", "text"])
            found: list[list[tuple]] = [[] for _ in range(len(ids))]
            for part in scan(iter([numbered])):
                for r in part.to_pylist():
                    found[r["row"]].append((r["item_id"], r["start"], r["end"], r["edits"]))
            hits = [sorted(x) for x in found]
            matches = pa.array([[{"item_id": i, "start": a, "end": b, "edits": n} for i, a, b, n in x] for x in hits], pa.list_(_match_type()))
            yield pa.record_batch([ids, matches], names=["doc_id", "matches"])

    return run


_MATCH_SQL = "array<struct<item_id: long, start: long, end: long, edits: int>>"


def _indexes(benchmark: DataFrame, q: int, rate: float):
    """The index of each block of items; one block reaches the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    for b in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else items
        yield blocks, Index([(r["item_id"], r["text"]) for r in some.orderBy("item_id", "text").collect()], q, rate)


def decontaminate(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated, n_items, items, least_edits, spans.

    ``items`` lists the benchmark items that the text holds within ``rate`` edits per
    byte, ascending, and ``spans`` item:start:end:edits in code points, comma-joined.  Null
    or empty text, and an empty benchmark, give no items.  Null items and ids of items
    are ignored.  An item of m bytes (folded) may have the whole part of ``rate`` m edits, so
    short ones must occur exactly; it is found wherever its grams are, whatever its length.  Rows that repeat an id
    are judged one by one.  Other columns are not read.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    numbered, parts = None, []
    for blocks, index in _indexes(benchmark, q, rate):
        if blocks == 1:
            out = base.mapInArrow(lean(_rows(index)), f"doc_id long, matches {_MATCH_SQL}")
            break
        if numbered is None:
            numbered = save(base.withColumn("row", F.monotonically_increasing_id()), "decontaminate")
        hits = numbered.select("row", "text").mapInArrow(lean(_scan(index)), "row long, item_id long, edits int, start long, end long")
        parts.append(save(hits, "matches"))
    else:
        every = parts[0]
        for x in parts[1:]:
            every = every.unionByName(x)
        every = every.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("item_id", "start", "end", "edits"))).alias("matches"))
        out = numbered.select("row", "doc_id").join(every, "row", "left").select("doc_id", F.coalesce("matches", F.expr(f"cast(array() as {_MATCH_SQL})")).alias("matches"))
    return out.select(
        "doc_id",
        (F.size("matches") > 0).alias("contaminated"),
        F.size("matches").cast("long").alias("n_items"),
        F.col("matches.item_id").alias("items"),
        F.array_min("matches.edits").alias("least_edits"),
        F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["item_id"], m["start"], m["end"], m["edits"])), ",").alias("spans"),
    )


def decontaminated_documents(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, columns unchanged."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = F.col(names[docs.columns.index("text")]).cast("string").alias("text")
    kept = numbered = save(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "decontaminate")
    for _, index in _indexes(benchmark, q, rate):
        hits = numbered.select("row", text).mapInArrow(lean(_scan(index)), "row long, item_id long, edits int, start long, end long")
        kept = kept.join(save(hits.select("row").distinct(), "leaks"), "row", "left_anti")
    return kept.select(*names).toDF(*docs.columns)
