"""Large groups of near copies and near misses against brute force."""

import random

import pytest

from tessera.llm import jaccard

from test_llm_operators import docs, prose, words


def components(texts, n, num, den):
    sets = []
    for t in texts:
        w = words(t)
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)))
    name = list(range(len(texts)))

    def root(i):
        while name[i] != i:
            name[i] = name[name[i]]
            i = name[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and k * den >= num * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                name[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("n,num,den,vocabulary", [(3, 9, 10, 100_000), (5, 4, 5, 2)])
def test_near_misses_of_one_text(spark, n, num, den, vocabulary):
    r = random.Random(n + vocabulary)
    base = [f"w{i}" for i in range(140)]
    texts = [" ".join(base)]
    for _ in range(300):
        t = list(base)
        for _ in range(r.randrange(1, 7)):
            at = r.randrange(len(t))
            kind = r.randrange(3)
            if kind == 0:
                t[at] = f"x{r.randrange(vocabulary)}"
            elif kind == 1:
                del t[at]
            else:
                t.insert(at, f"x{r.randrange(vocabulary)}")
        texts.append(" ".join(t))
    texts += [prose(i, 30 + i) + " w1 w2 w3 w4 w5 w6" for i in range(40)]
    want = components(texts, n, num, den)
    assert len(set(want)) > 45 and max(want.count(c) for c in set(want)) > 50
    got = {r.doc_id: r.component_id for r in jaccard.ngram_jaccard_join(docs(spark, texts), n, num, den).collect()}
    assert got == dict(enumerate(want))


def test_rows_that_repeat_an_id_are_judged_one_by_one(spark):
    rows = [(1, prose(1, 50)), (5, prose(1, 50) + " end"), (5, prose(2, 50)), (5, prose(2, 50)), (None, prose(3, 50)), (None, prose(3, 50)), (None, ""), (2**53 + 1, prose(4, 40)), (2**53 + 3, prose(4, 40)), (7, None)]
    d = spark.createDataFrame([(i, t, "gone", "many", "w", "root", 7) for i, t in rows], "doc_id long, text string, key_id string, key_t string, w string, root string, row long")
    kept = jaccard.near_distinct_documents(d)
    assert kept.columns == d.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([rows[0], rows[2], rows[4], rows[6], rows[7], rows[9]], key=str)
    out = jaccard.ngram_jaccard_join(d.where("doc_id > 100"), 3, 9, 10)
    assert {(r.doc_id, r.component_id) for r in out.collect()} == {(2**53 + 1, 2**53 + 1), (2**53 + 3, 2**53 + 1)}


def test_odd_bounds_the_difference():
    import numpy as np

    r = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(r.integers(0, 900, r.integers(0, 300)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        bits = sum(int(x).bit_count() for x in (jaccard.odd(a) ^ jaccard.odd(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))
