"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Texts are folded (A-Z lower-cased, white space one space).  A feature is the presence of
a character n-gram (``SIZES`` bytes long); every n-gram counts, by the cell of 2^``BITS``
that its hash names, so n-grams that share a cell are one feature.  From labelled rows
(at most ``SAMPLE``, with ``SAMPLE_BYTES`` of text) each cell gets its log-count ratio
r between the classes, smoothed by ``SMOOTH`` rows of the classes' shares, so a rare
n-gram has a ratio near 0.  The counts are made in the tasks and by a keyed sum.  A
logistic model is then trained on presence times r with a quadratic penalty.  Scoring is
one scan; the model is one number per cell.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, batches, gram_hashes, row_slices, utf8
from .decontaminate import fold
from .labelled import fold_of, labelled_sample

SIZES = (4, 5)
BITS = 22
#: Bounds of the labelled rows and of their bytes of text.
SAMPLE, SAMPLE_BYTES = 8000, 8 << 20
#: Cells of rows that training looks at together.
CHUNK = 1 << 20
SMOOTH, PENALTY, STEPS = 30.0, 1e-3, 80
WINDOW = 1 << 20


def gram_sets(buf: np.ndarray, offsets: np.ndarray):
    """Per row the sorted distinct cells of its n-grams."""
    for i, j in row_slices(offsets, WINDOW):
        folded, place = fold(buf[offsets[i] : offsets[j]])
        at = np.searchsorted(place, offsets[i : j + 1] - offsets[i])
        cells = [((gram_hashes(folded, q) ^ U64(q)) >> U64(64 - BITS)).astype(np.int32) if len(folded) <= 2 * WINDOW else None for q in SIZES]
        for k in range(j - i):
            a, b = int(at[k]), int(at[k + 1])
            parts = []
            for q, x in zip(SIZES, cells):
                if x is not None:
                    parts.append(x[a : max(a, b - q + 1)])
                else:  # a very long row, alone in its slice
                    for w in range(a, max(a, b - q + 1), WINDOW):
                        h = gram_hashes(folded[w : min(b, w + WINDOW + q - 1)], q)
                        parts.append(np.unique(((h ^ U64(q)) >> U64(64 - BITS)).astype(np.int32)))
            yield np.unique(np.concatenate(parts))


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        """``weights``: one per cell, its ratio included."""
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = [self.bias + self.weights[s].sum(dtype=np.float64) for s in gram_sets(buf, offsets)]
        return 0.5 * (1 + np.tanh(0.5 * np.array(z, float)))


def _counts(it):
    import pyarrow as pa

    yes, no = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
    for batch in it:
        texts, y = batches(batch, ["text", "y"])
        for label, cells in zip(y.to_pylist(), gram_sets(*utf8(texts))):
            (yes if label else no)[cells] += 1
    seen = np.flatnonzero(yes + no)
    yield pa.record_batch([pa.array(seen.astype(np.int32)), pa.array(yes[seen].astype(np.int64)), pa.array(no[seen].astype(np.int64))], names=["cell", "yes", "no"])


def _rows(it):
    import pyarrow as pa

    for batch in it:
        texts, y = batches(batch, ["text", "y"])
        x = [s.astype("<i4").tobytes() for s in gram_sets(*utf8(texts))]
        yield pa.record_batch([pa.array(x, pa.binary()), y], names=["x", "y"])


def train(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> Model:
    """The logistic model of rows of cells, by Adam on the whole sample, in chunks of rows."""
    n = np.array([len(x) for x in rows])
    seen = np.zeros(1 << BITS, bool)
    for x in rows:
        seen[x] = True
    cells = np.flatnonzero(seen)
    number = np.zeros(1 << BITS, np.int32)
    number[cells] = np.arange(len(cells))
    chunks, i = [], 0
    while i < len(rows):
        j = max(i + 1, int(np.searchsorted(np.cumsum(n[i:]), CHUNK, "right")) + i)
        some = np.flatnonzero(n[i:j])
        if len(some):
            chunks.append((i + some, n[i:j][some], number[np.concatenate(rows[i:j])]))
        i = j
    rate = ratios[cells].astype(np.float32)
    base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    w, b = np.zeros(len(cells), np.float32), np.log(base / (1 - base))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        scaled, total, gb = w * rate, np.zeros(len(cells)), 0.0
        for at, k, col in chunks:
            z = b + np.add.reduceat(scaled[col], np.cumsum(k) - k, dtype=np.float64)
            d = (0.5 * (1 + np.tanh(0.5 * z)) - y[at]) / len(rows)
            total += np.bincount(col, np.repeat(d, k), len(cells))
            gb += d.sum()
        bare = n == 0  # rows without n-grams teach the bias alone
        gb += ((0.5 * (1 + np.tanh(0.5 * b)) - y[bare]) / len(rows)).sum()
        g = rate * total.astype(np.float32) + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = 0.1 * (1 - t / (steps + 1))
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[cells] = w * rate
    return Model(weights, b)


def log_count_ratios(cell: np.ndarray, yes: np.ndarray, no: np.ndarray, n_yes: int, n_no: int) -> np.ndarray:
    """Per cell the log of the smoothed shares of the rows of either class that have it; 0 where no row has."""
    ratios = np.zeros(1 << BITS, np.float32)
    share = n_yes / (n_yes + n_no)
    a, b = SMOOTH * share, SMOOTH * (1 - share)
    ratios[cell] = np.log((yes + a) / (n_yes + a)) - np.log((no + b) / (n_no + b))
    return ratios


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0, sample: int = SAMPLE) -> Model:
    """A model of ``label``, from at most ``sample`` rows and SAMPLE_BYTES of text outside fold ``held`` (rows that repeat id and text count once).

    Without rows of both classes: the base rate.
    """
    rows = labelled_sample(docs, labels, label, folds, held, True, sample, SAMPLE_BYTES)
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    none = np.zeros(1 << BITS, np.float32)
    if not n.get(0) or not n.get(1):
        return Model(none, 0.0 if not n else (6.0 if n.get(1) else -6.0))
    # one row per cell at most
    counts = rows.mapInArrow(_counts, "cell int, yes long, no long").groupBy("cell").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).toPandas()
    ratios = log_count_ratios(counts["cell"].to_numpy(), counts["yes"].to_numpy(), counts["no"].to_numpy(), n[1], n[0])
    # in an order of their own, whatever order the tasks ended in
    got = sorted((r["y"], bytes(r["x"])) for r in rows.mapInArrow(_rows, "x binary, y int").toLocalIterator())
    return train([np.frombuffer(x, "<i4") for _, x in got], np.array([y for y, _ in got], float), ratios)


def _score(model: Model):
    def run(it):
        import pyarrow as pa

        for batch in it:
            ids, texts = batches(batch, ["doc_id", "text"])
            buf, offsets = utf8(texts)
            yield pa.record_batch([ids, pa.array(model.score(buf, offsets), pa.float64())], names=["doc_id", "score"])

    return run


def score_toxicity(docs: DataFrame, model: Model, folds: int = 5, held: int = 0) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null or empty text, or one shorter than an n-gram, holds none and gets the model's bias.  held_out is null only
    where doc_id is.  Other columns are not read.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = base.mapInArrow(_score(model), "doc_id long, score double")
    return out.select("doc_id", (fold_of(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


__all__ = ["Model", "fit_toxicity", "gram_sets", "log_count_ratios", "score_toxicity", "train"]
