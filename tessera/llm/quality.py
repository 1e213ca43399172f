"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words, all of them.  Each passage is
described by its make-up (kinds of characters, lengths and shapes of words, repetition,
hashed character pairs) and encoded by a learned layer.  Gated attention,
softmax(w (tanh(V e) * sigmoid(U e))), weighs the passages; the weighted sum of their
encodings is the document, scored by a logistic layer.  Only document labels train it:
Adam on bags, on at most ``SAMPLE`` labelled rows.  The model is some thousand numbers
and goes to the tasks with their code; scoring is one scan.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SLICE, SPACE, batches, lean, row_slices, span_hashes, utf8, words
from .labelled import fold_of, labelled_sample

PASSAGE = 64
#: Bounds of the labelled rows a model is fitted on, and of their bytes of text (their features take some four times as much).
SAMPLE, SAMPLE_BYTES = 4000, 32 << 20
ENCODED, GATE, EPOCHS, BAGS = 24, 16, 12, 32
PAIRS = 48

_PUNCT = [ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]
_CLASS = np.zeros(256, np.uint8)  # 0: others
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[128:] = 4
for _i, _c in enumerate(_PUNCT):
    _CLASS[_c] = 5 + _i
_CLASS[10] = 5 + len(_PUNCT)
CLASSES = 6 + len(_PUNCT)
WIDTH = CLASSES + 9 + PAIRS


def passage_features(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of the passages of rows that begin at ``at``, passages per row)."""
    s, e = words(buf, at)
    bounds = np.searchsorted(s, at)
    n_words = np.diff(bounds)
    n_pass = -(-n_words // PASSAGE)
    total = int(n_pass.sum())
    if not total:
        return np.zeros((0, WIDTH), np.float32), n_pass
    row = np.repeat(np.arange(len(n_words)), n_words)
    within = np.arange(len(s)) - bounds[row]
    first = np.concatenate([[0], np.cumsum(n_pass)[:-1]])
    p = first[row] + within // PASSAGE  # passage of each word
    size = np.bincount(p, minlength=total).astype(float)
    new = np.flatnonzero(np.diff(p, prepend=-1))
    begin, end = s[new], np.append(e[new[1:] - 1], e[-1])
    # bytes of the passages, including the space between their words
    of = np.full(len(buf), -1, np.int64)
    mark = np.zeros(len(buf) + 1, np.int64)
    mark[begin] += 1
    mark[end] -= 1
    inside = np.cumsum(mark[:-1]) > 0
    starts = np.zeros(len(buf), np.int64)
    starts[begin] = 1
    of[inside] = np.cumsum(starts)[inside] - 1
    at_in = np.flatnonzero(inside)
    kinds = np.bincount(of[at_in] * CLASSES + _CLASS[buf[at_in]], minlength=total * CLASSES).reshape(total, CLASSES).astype(float)
    length = np.maximum(1, end - begin)
    pair_at = at_in[:-1][np.diff(at_in) == 1]
    pair = ((LOWER[buf[pair_at]].astype(np.int64) * 31 + LOWER[buf[pair_at + 1]]) * 2654435761 >> 7) % PAIRS
    pairs = np.bincount(of[pair_at] * PAIRS + pair, minlength=total * PAIRS).reshape(total, PAIRS) / length[:, None]
    size_w = e - s
    mean = np.bincount(p, size_w, total) / size
    var = np.bincount(p, size_w.astype(float) ** 2, total) / size - mean**2
    h = span_hashes(LOWER[buf], s, e)
    same = np.zeros(len(s))
    same[1:] = (h[1:] == h[:-1]) & (p[1:] == p[:-1])
    order = np.lexsort((h, p))
    fresh = np.ones(len(s))
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (p[order][1:] != p[order][:-1])
    distinct = np.bincount(p[order], fresh, total) / size
    head, tail = buf[s], buf[e - 1]
    upper = (head >= 65) & (head <= 90)
    shout = upper & (_CLASS[buf[np.minimum(s + 1, e - 1)]] == 2)
    odd = (_CLASS[tail] >= 5) & (tail != 44) & (tail != 46)
    share = lambda x: np.bincount(p, x.astype(float), total) / size
    extra = np.stack([np.log1p(mean), np.sqrt(np.maximum(var, 0)) / 8, np.bincount(p, same, total) / size, distinct, share(upper), share(shout), share(odd), share(size_w <= 3), np.log(size) / 4], 1)
    return np.concatenate([np.sqrt(kinds / length[:, None]), extra, np.sqrt(pairs)], 1).astype(np.float32), n_pass


def _whole_passages(text: np.ndarray, a: int, size: int) -> int:
    """End of a window from ``a`` on, of some ``size`` bytes, that holds whole passages or the rest of the text."""
    while True:
        b = min(len(text), a + size)
        while b < len(text) and not SPACE[text[b]]:
            b += 1  # a word is never cut
        if b == len(text):
            return b
        s, _ = words(text[a:b], np.array([0, b - a]))
        if len(s) > PASSAGE:
            return a + int(s[(len(s) - 1) // PASSAGE * PASSAGE])  # the next passage begins here
        size *= 2


def bags(buf: np.ndarray, offsets: np.ndarray):
    """Per group of rows i..j: features of all their passages and passages per row.

    A row above SLICE bytes is read in windows that end with a whole passage, so its
    passages are the same whatever SLICE is.
    """
    for i, j in row_slices(offsets):
        part = buf[offsets[i] : offsets[j]]
        if len(part) <= SLICE:
            yield i, j, *passage_features(part, offsets[i : j + 1] - offsets[i])
            continue
        found, a = [], 0
        while a < len(part):
            b = _whole_passages(part, a, SLICE)
            found.append(passage_features(part[a:b], np.array([0, b - a]))[0])
            a = b
        x = np.concatenate(found)
        yield i, j, x, np.array([len(x)])


def _sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * z))


class Model:
    """Encoder (A, a), gate (V, U, w) and scorer (c, d); numpy, serialised with the task's code."""

    NAMES = ("A", "a", "V", "U", "w", "c", "d")

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.mean, self.sd = np.zeros(WIDTH), np.ones(WIDTH)
        self.A, self.a = r.normal(0, WIDTH**-0.5, (WIDTH, ENCODED)), np.zeros(ENCODED)
        self.V, self.U = r.normal(0, ENCODED**-0.5, (ENCODED, GATE)), r.normal(0, ENCODED**-0.5, (ENCODED, GATE))
        self.w, self.c, self.d = np.zeros(GATE), r.normal(0, 0.1, ENCODED), np.zeros(1)

    def forward(self, x: np.ndarray, n: np.ndarray) -> tuple:
        """x: standardised passages; n: passages per row, none of them 0."""
        at = np.concatenate([[0], np.cumsum(n)[:-1]])
        e = np.tanh(x @ self.A + self.a)
        t, g = np.tanh(e @ self.V), _sigmoid(e @ self.U)
        z = (t * g) @ self.w
        z = np.exp(z - np.repeat(np.maximum.reduceat(z, at), n))
        weight = z / np.repeat(np.add.reduceat(z, at), n)
        doc = np.add.reduceat(e * weight[:, None], at, axis=0)
        return at, e, t, g, weight, doc, _sigmoid(doc @ self.c + self.d)

    def score(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Scores of rows; one without passages is the empty document, with a zero representation."""
        out = np.full(len(n), float(_sigmoid(self.d)[0]))
        some = n > 0
        if some.any():
            out[some] = self.forward((x - self.mean) / self.sd, n[some])[-1]
        return out

    def fit(self, x: np.ndarray, n: np.ndarray, y: np.ndarray, seed: int = 7) -> "Model":
        r = np.random.default_rng(seed)
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        base = float(np.clip(y.mean() if len(y) else 0.5, 0.02, 0.98))
        self.d = np.array([np.log(base / (1 - base))])
        use = np.flatnonzero(n > 0)
        if not len(use) or y.min() == y.max():
            self.c = np.zeros(ENCODED)  # nothing to tell apart: the base rate for all
            return self
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-3
        x = ((x - self.mean) / self.sd).astype(np.float64)
        m = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        v = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        step = 0
        for epoch in range(EPOCHS):
            r.shuffle(use)
            for some in (use[i : i + BAGS] for i in range(0, len(use), BAGS)):
                k = n[some]
                rows = np.repeat(starts[some] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
                xb = x[rows]
                at, e, t, g, weight, doc, s = self.forward(xb, k)
                ds = (s - y[some]) / len(some)
                d_doc = ds[:, None] * self.c
                back = np.repeat(d_doc, k, axis=0)
                dw = (e * back).sum(1)
                dz = weight * (dw - np.repeat(np.add.reduceat(dw * weight, at), k))
                dtg = dz[:, None] * self.w
                dt, dg = dtg * g * (1 - t**2), dtg * t * g * (1 - g)
                de = back * weight[:, None] + dt @ self.V.T + dg @ self.U.T
                de *= 1 - e**2
                grad = {"A": xb.T @ de, "a": de.sum(0), "V": e.T @ dt, "U": e.T @ dg, "w": (t * g).T @ dz, "c": doc.T @ ds, "d": np.array([ds.sum()])}
                step += 1
                rate = 0.01 * (1 - epoch / EPOCHS) + 5e-4
                for name in self.NAMES:
                    p = getattr(self, name)
                    q = grad[name] + 1e-4 * p * (name != "d")
                    m[name] = 0.9 * m[name] + 0.1 * q
                    v[name] = 0.999 * v[name] + 0.001 * q * q
                    setattr(self, name, p - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8))
        return self


def _features(it):
    import pyarrow as pa

    for batch in it:
        texts, ys = batches(batch, ["text", "y"])
        buf, offsets = utf8(texts)
        for i, j, x, n in bags(buf, offsets):
            ends = np.cumsum([0, *n])
            yield pa.record_batch([pa.array([x[a:b].astype("<f4").tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary()), ys.slice(i, j - i)], names=["x", "y"])


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1, sample: int = SAMPLE) -> Model:
    """A model of ``label``, from at most ``sample`` rows and SAMPLE_BYTES of text outside fold ``held`` (rows that repeat id and text count once).  Without rows: 0.5 for all."""
    rows = labelled_sample(docs, labels, label, folds, held, True, sample, SAMPLE_BYTES)
    got = rows.mapInArrow(lean(_features), "x binary, y int").toPandas()
    xs = [np.frombuffer(b, "<f4").reshape(-1, WIDTH) for b in got["x"]]
    order = sorted(range(len(xs)), key=lambda i: (got["y"][i], xs[i].tobytes()[:4096], len(xs[i])))  # whatever order the tasks ended in
    xs = [xs[i] for i in order]
    y = got["y"].to_numpy(float)[order] if len(xs) else np.zeros(0)
    if not xs:
        model = Model()
        model.c = np.zeros(ENCODED)
        return model
    return Model().fit(np.concatenate(xs), np.array([len(x) for x in xs]), y)


def _score(model: Model):
    def run(it):
        import pyarrow as pa

        for batch in it:
            ids, texts = batches(batch, ["doc_id", "text"])
            buf, offsets = utf8(texts)
            for i, j, x, n in bags(buf, offsets):
                yield pa.record_batch([ids.slice(i, j - i), pa.array(model.score(x, n), pa.float64())], names=["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, model: Model, folds: int = 3, held: int = 1) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null or empty text gets the score of an empty bag.  held_out is null only where
    doc_id is.  Other columns are not read.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = base.mapInArrow(lean(_score(model)), "doc_id long, score double")
    return out.select("doc_id", (fold_of(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _keep(model: Model, columns: list[str]):
    def run(it):
        import pyarrow as pa

        for batch in it:
            (texts,) = batches(batch, ["text"])
            buf, offsets = utf8(texts)
            good = np.concatenate([np.zeros(0, bool), *(model.score(x, n) >= 0.5 for _, _, x, n in bags(buf, offsets))])
            yield batch.filter(pa.array(good))

    return run


def quality_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model accepts, columns unchanged."""
    return docs.mapInArrow(lean(_keep(model, docs.columns)), docs.schema)
