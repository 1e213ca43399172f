"""Odd rows for every operator: null and large ids, texts above a slice, repeated rows, ties, layouts; and brute-force forms of what SQL can't say."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_llm_operators import docs, labelled_docs, prose, words
from tessera.llm import common, decontaminate, html_text, jaccard, labelled, mixing, ngram_lm, pii, quality, token_files, toxicity

BIG = 2**53 + 1


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, ids above 2^53, repeated rows, no text."""
    rows = [(BIG, prose(1, 40), "s"), (BIG + 2, prose(2, 40), None), (None, prose(3, 40), "s"), (None, prose(3, 40), "s"), (BIG, prose(1, 40), "s"), (7, None, "t"), (8, "", "t")]
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, source string, row long, rank long, t string").coalesce(2)


IDS = sorted([BIG, BIG, BIG + 2, 7, 8])


def ids(df):
    got = [r.doc_id for r in df.select("doc_id").collect()]
    assert len(got) == 7 and got.count(None) == 2
    return sorted(i for i in got if i is not None)


def test_every_operator_keeps_ids_and_rows(spark, odd):
    import public_tokenizers

    d, labels = labelled_docs(spark, 60)
    bench = spark.createDataFrame([(BIG, prose(2, 40))], "item_id long, text string")
    model = quality.fit_quality(d, labels)
    assert ids(jaccard.ngram_jaccard_join(odd, 3, 9, 10)) == IDS
    assert ids(quality.score_quality(odd, model)) == IDS
    assert quality.quality_documents(odd, model).columns == odd.columns
    hit = decontaminate.decontaminate(odd, bench)
    assert ids(hit) == IDS and [list(r["items"]) for r in hit.where("contaminated").collect()] == [[BIG]]
    assert sorted(r.doc_id or 0 for r in decontaminate.decontaminated_documents(odd, bench).collect()) == [0, 0, 7, 8, BIG, BIG]
    assert ids(toxicity.score_toxicity(odd, toxicity.fit_toxicity(d, labels))) == IDS
    assert ids(ngram_lm.score_documents(odd)) == IDS
    assert ids(mixing.mix_sources(odd)) == IDS
    kept = mixing.mixed_documents(odd)
    assert kept.columns == odd.columns and {(r.row, r.rank, r.t) for r in kept.collect()} == {(1, 2, "x")}
    assert ids(pii.find_personal_data(odd)) == IDS
    assert ids(token_files.token_output(odd, public_tokenizers.path("byte_bpe_50k.json"))) == IDS
    pages = odd.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), "t")
    assert html_text.extract_main_text(pages).where("page_id is null").count() == 2


def test_the_mix_is_the_same_in_any_layout(spark):
    texts = ["w " * (3 + i % 5) for i in range(90)] + ["twice same"] * 4 + [None]
    sources = ["big"] * 60 + ["b"] * 25 + ["c"] * 5 + ["b"] * 4 + [None]
    d = docs(spark, texts, sources)
    d = d.unionByName(d.where("doc_id < 5"))
    take = lambda x: sorted((r.doc_id, r.size, r.taken) for r in mixing.mix_sources(x).collect())
    assert take(d.coalesce(1)) == take(d.repartition(5, F.rand(3))) == take(d.orderBy(F.desc("doc_id")))


def test_small_sources_come_near_their_target(spark):
    # one source of 2,000,000 words in four rows, and small ones: sizes alone, through the plan
    rows = [(i, i, i, 0, "a", 500_000_000) for i in range(4)] + [(10 + i, 10 + i, i, 0, "b", 7) for i in range(5)] + [(20, 20, 1, 0, "c", 1)]
    df = spark.createDataFrame(rows, "row long, doc_id long, t long, rank long, source string, size long")
    got = mixing.mix_plan(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    for r in got:
        assert abs(r.taken - r.target) <= 1 + r.target / 50, r


def test_taken_against_a_ring_of_words(spark):
    texts = ["w " * (1 + i % 7) for i in range(60)]
    d = docs(spark, texts, ["a"] * 45 + ["b"] * 15)
    rows = mixing._sizes(d.select("doc_id", "source", "text").withColumn("row", F.monotonically_increasing_id()))
    plan = mixing.mix_plan(rows).collect()
    for s in ("a", "b"):
        some = [r for r in plan if r.source == s]
        total, length = sum(r.taken for r in some), sum(r.size for r in some)
        laps = {r.taken // r.size for r in some}
        # a run of words round the rings: every document is taken floor(total / length) times, and at most one lap more
        assert abs(total - some[0].target) <= 2 and laps <= {total // length, total // length + 1} and all(r.taken <= 3 * r.size for r in some)


def test_passages_do_not_depend_on_windows(monkeypatch):
    text = (prose(1, 3000) + "\n\n" + prose(2, 2000)).encode()
    buf, at = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    (_, _, want, n), = quality.bags(buf, at)
    for size in (300, 1000, 4096):
        monkeypatch.setattr(quality, "SLICE", size)
        (_, _, got, m), = list(quality.bags(buf, at))[-1:]
        assert list(m) == list(n) and np.allclose(got, want)


def test_texts_above_a_slice(spark):
    long = prose(5, 180_000)  # above 1 MiB
    assert len(long) > common.SLICE
    d, labels = labelled_docs(spark, 60)
    more = docs(spark, [long, long + " tail", prose(6, 50)], start=900)
    model = quality.fit_quality(d, labels)
    got = {r.doc_id: r.score for r in quality.score_quality(more, model).collect()}
    x, n = quality.passage_features(np.frombuffer(long.encode(), np.uint8), np.array([0, len(long)]))
    assert got[900] == pytest.approx(float(model.score(x, n)[0])) and n[0] == -(-180_000 // quality.PASSAGE)
    assert {r.doc_id: r.component_id for r in jaccard.ngram_jaccard_join(more, 3, 9, 10).collect()} == {900: 900, 901: 900, 902: 902}
    item = " ".join(long.split()[150_000:150_030])
    hit = decontaminate.decontaminate(more, spark.createDataFrame([(1, item)], "item_id long, text string")).where("contaminated").collect()
    assert {r.doc_id for r in hit} == {900, 901} and long[int(hit[0].spans.split(":")[1]) :].startswith(item)
    tox = toxicity.fit_toxicity(d, labels)
    assert toxicity.score_toxicity(more, tox).count() == 3
    lm = {r.doc_id: r.n_words for r in ngram_lm.score_documents(more, 3).collect()}
    assert lm == {900: 180_000, 901: 180_001, 902: 50}


def test_forward_pass_of_a_bag():
    """Gated attention over one bag, written out."""
    r = np.random.default_rng(1)
    m = quality.Model()
    m.w, m.c = r.normal(size=quality.GATE), r.normal(size=quality.ENCODED)
    x = r.normal(size=(7, quality.WIDTH))
    e = np.tanh(x @ m.A + m.a)
    z = [float(sum(m.w[k] * np.tanh(e[i] @ m.V[:, k]) / (1 + np.exp(-(e[i] @ m.U[:, k]))) for k in range(quality.GATE))) for i in range(7)]
    a = np.exp(z) / np.exp(z).sum()
    want = 1 / (1 + np.exp(-(float((a[:, None] * e).sum(0) @ m.c) + m.d[0])))
    got = m.score(np.vstack([x, x[:2]]) * m.sd + m.mean, np.array([7, 0, 2]))
    assert got[0] == pytest.approx(want) and got[1] == pytest.approx(0.5)


def test_sample_is_bounded_in_rows_and_bytes(spark):
    d = docs(spark, ["word " * 10] * 3).select("doc_id", "text")
    d = d.unionByName(d).unionByName(d.select("doc_id", F.concat("text", F.lit("x")).alias("text")))
    labels = spark.createDataFrame([(i, 1) for i in range(3)], "doc_id long, quality int")
    some = lambda rows, size: labelled.labelled_sample(d, labels, "quality", 3, 5, True, rows, size).collect()
    assert len(some(100, 1 << 20)) == 6 and len(some(2, 1 << 20)) == 2 and len(some(100, 120)) == 2


def test_toxicity_scores_from_counts():
    """Ratios and scores of the linear model, written out over sets of n-grams."""
    texts, y = ["ab cd ef", "AB  cd", "zz yy xx", "zz yy ww", ""], np.array([1.0, 1, 0, 0, 0])
    raw = [t.encode() for t in texts]
    buf, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    sets = list(toxicity.gram_sets(buf, at))

    def grams(t):
        t = " ".join(t.lower().split())
        return {t[i : i + q] for q in toxicity.SIZES for i in range(len(t) - q + 1)}

    assert [len(s) for s in sets] == [len(grams(t)) for t in texts] and len(set(sets[0]) & set(sets[1])) == len(grams(texts[0]) & grams(texts[1]))
    yes, no = np.zeros(1 << toxicity.BITS), np.zeros(1 << toxicity.BITS)
    for s, label in zip(sets, y):
        (yes if label else no)[s] += 1
    cells = np.flatnonzero(yes + no)
    ratios = toxicity.log_count_ratios(cells, yes[cells], no[cells], 2, 3)
    a, b = toxicity.SMOOTH * 2 / 5, toxicity.SMOOTH * 3 / 5
    assert ratios[sets[1][0]] == pytest.approx(np.log((2 + a) / (2 + a)) - np.log(b / (3 + b)) if yes[sets[1][0]] == 2 else np.log((1 + a) / (2 + a)) - np.log(b / (3 + b)))
    model = toxicity.train(sets, y, ratios)
    got = model.score(buf, at)
    assert got == pytest.approx([1 / (1 + np.exp(-(model.bias + sum(float(model.weights[c]) for c in s)))) for s in sets])
    assert got[0] > got[2] and got[4] == pytest.approx(1 / (1 + np.exp(-model.bias)))


def brute_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_decontamination_against_brute_force():
    """Items of all lengths around the short ones, edited: found exactly if within the budget."""
    r = random.Random(4)
    items = [(i, "".join(r.choice("abcdefgh ") for _ in range(n)).strip() or "a") for i, n in enumerate([5, 11, 12, 19, 20, 21, 22, 23, 24, 39, 40, 41, 60, 90])]
    index = decontaminate.Index(items)
    texts = []
    for _ in range(120):
        t = list(r.choice(items)[1])
        for _ in range(r.randrange(4)):
            k = r.randrange(len(t))
            t[k : k + 1] = r.choice([[], ["q"], [t[k], "q"]])
            t = t or ["a"]
        texts.append("".join(r.choice("xyz") for _ in range(r.randrange(30))) + "".join(t) + "".join(r.choice("xyz ") for _ in range(r.randrange(30))))
    import pyarrow as pa

    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["row", "text"])
    got = {(x["row"], x["item_id"]): x["edits"] for part in decontaminate._scan(index)(iter([batch])) for x in part.to_pylist()}
    fold = lambda t: " ".join(t.lower().split())
    want = {}
    for k, t in enumerate(texts):
        for i, item in items:
            item = fold(item)
            n = brute_edits(item, fold(t))
            if n <= int(decontaminate.RATE * len(item)):
                want[k, i] = n
    assert got == want and any(want.values())


def test_openings_that_many_items_share():
    import resource

    opening = "Which of the following statements about the subject is true? "
    items = [(i, opening + prose(i, 20)) for i in range(4000)]
    index = decontaminate.Index(items)
    text = (opening * 140 + items[17][1]).lower().encode()
    buf, _ = decontaminate.fold(np.frombuffer(text, np.uint8))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = {i for _, i, low, high in index.regions(buf, np.array([0])) if index.verify(buf, i, low, high)}
    assert found == {17} and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # KB
    run = "a" * 300_000
    again = decontaminate.Index([(1, "a" * 200)])
    buf, _ = decontaminate.fold(np.frombuffer(run.encode(), np.uint8))
    assert next(again.regions(buf, np.array([0])))[1] == 0
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_200_000


def test_held_out_marks_without_id(spark, odd):
    d, labels = labelled_docs(spark, 60)
    for got, folds, held in ((quality.score_quality(odd, quality.fit_quality(d, labels)), 3, 1), (toxicity.score_toxicity(odd, toxicity.fit_toxicity(d, labels)), 5, 0)):
        for r in got.collect():
            assert r.held_out == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % folds == held) and 0 <= r.score <= 1
    assert words(None) == []
