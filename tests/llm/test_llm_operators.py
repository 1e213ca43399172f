"""The training-data operators against brute force, on small tables with every odd case."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import components, cuckoo, decontaminate, html_text, jaccard, labelled, mixing, ngram_lm, pii, quality, rans, token_files, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, row long"
SPACE = r"[\x20\x09-\x0D]+"


def docs(spark, texts, sources=None, start=0):
    """Documents with columns whose names clash with the operators' own."""
    rows = [(i + start, t, "en", (sources or ["a"] * len(texts))[i], len(t or ""), 1.0, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["ba", "da", "ga", "ka", "la", "ma"]) + r.choice(["ro", "so", "to", "vo"]) + str(r.randrange(40)) for _ in range(n))


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [w for w in re.split(SPACE, t) if w]


def brute_components(texts, n, num, den):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    name = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                k = len(sets[i] & sets[j])
                if sets[i] and k * den >= num * len(sets[i] | sets[j]):
                    name[i] = name[j] = min(name[i], name[j])
    return sets, name


@pytest.mark.parametrize("n,num,den", [(3, 9, 10), (5, 4, 5)])
def test_jaccard_join(spark, n, num, den):
    base = prose(1, 120).split()
    texts = [None, "", "  \n", "one two", "One\ttwo", "one", " ".join(base), " ".join(base).upper(), prose(2, 3000)]
    for k in range(12):
        r = random.Random(k)
        edited = list(base)
        for _ in range(k % 5):
            edited[r.randrange(len(edited))] = f"x{k}"
        texts.append(" ".join(edited))
    texts += [prose(9, 60)] * 3
    sets, name = brute_components(texts, n, num, den)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.ngram_jaccard_join(docs(spark, texts), n, num, den).collect()}
    assert got == {i: (len(sets[i]), name[i]) for i in range(len(texts))}


def test_jaccard_repeated_rows_and_empty(spark):
    d = docs(spark, [prose(3, 40)])
    out = jaccard.ngram_jaccard_join(d.unionByName(d), 3, 9, 10).collect()
    assert len(out) == 2 and {r.component_id for r in out} == {0}
    assert jaccard.near_distinct_documents(d.unionByName(d)).count() == 1
    assert jaccard.ngram_jaccard_join(empty(spark), 3, 9, 10).count() == 0
    assert jaccard.near_distinct_documents(docs(spark, [prose(3, 40), prose(3, 40) + " end", None, ""])).columns == DOCS.replace(" long", "").replace(" string", "").replace(" double", "").split(", ")


@pytest.mark.parametrize("per_task", [500_000, 7])
def test_components_of_a_chain(spark, monkeypatch, per_task):
    monkeypatch.setattr(components, "PER_TASK", per_task)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (2**53 + 1, 2**53 + 3)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 2**53 + 1: 2**53 + 1, 2**53 + 3: 2**53 + 1}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cuckoo_index_against_a_dict():
    r, index, want = random.Random(4), cuckoo.CuckooIndex(2), {}
    for step in range(6000):
        key = hashlib.sha256(str(r.randrange(2500)).encode()).digest()
        if r.random() < 0.7:
            index.put(key, step)
            want[key] = step
        else:
            assert index.delete(key) == (want.pop(key, None) is not None)
    assert dict(index.items()) == want and len(index) == len(want) and index.resizes > 0
    assert all(index.get(k) == v for k, v in want.items()) and index.get(b"x" * 32) is None


def test_exact_dedup(spark):
    texts = ["a  b", "a b", "a\n\tb", " a b", None, "", "é", "é"] + ["same"] * 40
    got = cuckoo.exact_dedup(docs(spark, texts, start=5)).collect()
    norm = [re.sub(SPACE, " ", t or "") for t in texts]
    for r in got:
        t = norm[r.doc_id - 5]
        group = [i + 5 for i, x in enumerate(norm) if x == t]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (group[0], len(group), r.doc_id == group[0], hashlib.sha256(t.encode()).hexdigest())
    d = docs(spark, ["x"])
    assert sorted(r.kept for r in cuckoo.exact_dedup(d.unionByName(d)).collect()) == [False, True]
    assert cuckoo.exact_dedup(empty(spark)).count() == 0
    big = spark.createDataFrame([(2**53 + 1, "x"), (None, "x"), (2**53 + 3, "y"), (None, "z"), (None, "z")], "doc_id long, text string").coalesce(1)
    want = [(None, None, 2, False), (None, None, 2, True), (None, 2**53 + 1, 2, False), (2**53 + 1, 2**53 + 1, 2, True), (2**53 + 3, 2**53 + 3, 1, True)]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in cuckoo.exact_dedup(big).collect()), key=str) == sorted(want, key=str)
    index = cuckoo.live_index(docs(spark, ["a", "b"]))
    left = cuckoo.update_index(index, docs(spark, ["c"], start=9), docs(spark, ["a"])).collect()
    assert {r.doc_id for r in left} == {1, 9}


def test_cuckoo_flush_keeps_groups(spark, monkeypatch):
    monkeypatch.setattr(cuckoo, "KEYS_PER_INDEX", 3)
    got = cuckoo.exact_dedup(docs(spark, [f"t{i % 7}" for i in range(50)])).collect()
    assert {r.keep_id for r in got} == set(range(7)) and sum(r.group_size for r in got if r.kept) == 50


def test_apportion_equals_highest_quotients(spark):
    r = random.Random(6)
    for seats in (1, 17, 500):
        votes = [r.randrange(0, 1000) for _ in range(12)]
        df = spark.createDataFrame([(0, i, v, seats) for i, v in enumerate(votes)], "p int, k int, v long, s long")
        got = {x.k: x.quota for x in mixing.apportion(df, ["p"], "k", "v", "s").collect()}
        best = sorted(((-(v / (2 * j - 1)), -v, i, j) for i, v in enumerate(votes) if v for j in range(1, seats + 1)))[:seats]
        assert got == {i: sum(b[2] == i for b in best) for i in range(12)}


def test_mixing(spark):
    texts = ["w " * (3 + i % 5) for i in range(120)] + [None, "", " "]
    sources = ["big"] * 80 + ["b"] * 30 + ["c"] * 10 + [None, "c", None]
    out = mixing.mix_sources(docs(spark, texts, sources)).toPandas()
    assert len(out) == 123 and (out["taken"] <= 3 * out["size"]).all() and (out["size"] == [len(words(texts[i])) for i in out["doc_id"]]).all()
    per = out.groupby(out["source"].fillna("~")).agg(taken=("taken", "sum"), target=("target", "max"), size=("source_size", "max"))
    assert (abs(per["taken"] - per["target"]) <= 3).all() and (per["target"] <= 3 * per["size"] + 1e-9).all()
    again = mixing.mix_sources(docs(spark, texts, sources)).toPandas()
    assert dict(zip(out["doc_id"], out["taken"])) == dict(zip(again["doc_id"], again["taken"]))
    assert mixing.mix_sources(empty(spark)).count() == 0
    assert mixing.mix_sources(docs(spark, [None, ""])).agg(F.sum("taken"), F.max("target")).first() == (0, 0.0)
    kept = mixing.mixed_documents(docs(spark, texts, sources))
    assert kept.columns == docs(spark, ["x"]).columns and kept.count() > 0


def test_targets_are_a_water_level(spark):
    sizes = {"a": 10, "b": 400, "c": 1000, "d": 5, "e": 700}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), 3).collect()}
    weight = dict(zip(sorted(sizes), [5, 2, 1, 5, 2]))
    left, full = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in full]
        level = (left - sum(full.values())) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 3 * sizes[s]]
        if not over:
            break
        full |= {s: 3 * sizes[s] for s in over}
    assert got == pytest.approx({s: full.get(s, weight[s] * level) for s in sizes})


def test_rans_round_trip():
    r = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 5000, 700_001):
        ids = np.minimum(r.zipf(1.4, n), 50_000).astype(np.uint16)
        table = rans.Table(rans.scale(np.bincount(ids, minlength=50_257)))
        data = rans.encode(ids, table)
        assert (rans.decode(data, table) == ids).all()
    block = rans.encode_block(ids[: rans.BLOCK], table)
    lanes = 4096
    assert (rans.decode_block(memoryview(block), table, 0) == ids[rans.CHECKPOINT_STEPS * lanes : rans.BLOCK]).all()
    bad = bytearray(data)
    bad[-1] ^= 1
    with pytest.raises(ValueError):
        rans.decode(bytes(bad), table)


def test_token_output(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = [None, "", " ", "a  b", "It's\n\n x", "<|endoftext|> é", "日本 語", prose(1, 4000), " lead", "trail ", "tab\t x\n y", "a  b", "x" * 3000]
    got = {r.doc_id: r for r in token_files.token_output(docs(spark, texts).orderBy(F.desc("doc_id")), path).collect()}
    at = 0
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.token_output(empty(spark), path).count() == 0


def test_personal_data(spark):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    r = random.Random(8)
    pieces = ["a@b.c", "x.y@", "@d.e", "1.2.3.4", "300.1.1.1", "4111 1111-1111 1111", "4111111111111112", "+1 (988) 555-2485", "+12", "...", "12", "a", " ", ".", "5"]
    for _ in range(400):
        t = "".join(r.choice(pieces) + r.choice(["", " "]) for _ in range(8))
        got = pii.find_base(t)
        assert [s[1:] for s in got if s[0] == "email"] == [m.span() for m in email.finditer(t)]
        assert [s[1:] for s in got if s[0] == "ip"] == [m.span() for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    hidden = {
        "mail jo (at) web dot org now": "email", "jo at web dot org": "email", "jо@wеb.org": "email", "call plus four nine one two three four five six seven eight": "phone",
        "ip one nine two dot one six eight dot one dot one": "ip", "card ４111 1111 1111 1111": "card", "x​@web.org": "email",
    }
    for t, kind in hidden.items():
        base, every = pii.find_all(t)
        assert set(base) <= set(every) and any(s[0] == kind and s not in base for s in every), t
        assert all(0 <= a < b <= len(t) for _, a, b in every)
    assert pii.find_all("jo (at) web dot org")[1] == [("email", 0, 19)]
    assert pii.find_all("we met at noon, on the dot of two, one or two")[1] == []
    out = pii.find_personal_data(docs(spark, [None, "", "a@b.c +1 988 555 2485"])).orderBy("doc_id").collect()
    assert [r.n_email for r in out] == [0, 0, 1] and out[2].spans == "email:0:5,phone:6:21"
    assert out[0].base_sha256 == hashlib.sha256(b"").hexdigest() and pii.find_personal_data(empty(spark)).count() == 0
    assert pii.mask_personal_data(docs(spark, ["a@b.c x", None])).orderBy("doc_id").collect()[0].text == "<email> x"


def test_decontamination(spark):
    items = [prose(i, 30) for i in range(6)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(8, None), (9, "tiny item"), (None, prose(77, 20))], "item_id long, text string")
    edited = items[2].replace("a", "e", 3)
    edited = edited[:60] + "XY" + edited[60:]
    texts = [prose(50, 200), prose(51, 50) + " " + items[1].upper().replace(" ", "\n  ") + " " + prose(52, 40), "é " + edited + " z", items[3][: len(items[3]) // 2], None, "", "a tiny item here", items[4]]
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs(spark, texts), bench).collect()}
    assert {i: list(r["items"]) for i, r in got.items()} == {0: [], 1: [1], 2: [2], 3: [], 4: [], 5: [], 6: [9], 7: [4]}
    assert got[1].least_edits == 0 and got[2].least_edits == 5
    _, a, b, _ = map(int, got[7].spans.split(":"))
    assert (a, b) == (0, len(items[4]))
    a, b = map(int, got[1].spans.split(":")[1:3])
    assert texts[1][a:b].split() == items[1].upper().split()
    kept = decontaminate.decontaminated_documents(docs(spark, texts), bench)
    assert {r.doc_id for r in kept.collect()} == {0, 3, 4, 5} and kept.columns == docs(spark, ["x"]).columns
    assert decontaminate.decontaminate(empty(spark), bench).count() == 0
    assert decontaminate.decontaminate(docs(spark, texts), bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    items = [prose(i, 30) for i in range(6)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    got = {r.doc_id: list(r["items"]) for r in decontaminate.decontaminate(docs(spark, [items[0] + " " + items[5], prose(9, 9), None]), bench).collect()}
    assert got == {0: [0, 5], 1: [], 2: []}


def test_edits_against_full_table():
    r = random.Random(2)
    for _ in range(60):
        item = bytes(r.choice(b"ab") for _ in range(r.randrange(1, 12)))
        text = bytes(r.choice(b"ab") for _ in range(r.randrange(0, 15)))
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            new = [i]
            for j, d in enumerate(text, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
            row = new
        n, end = decontaminate.edits(np.frombuffer(item, np.uint8), np.frombuffer(text, np.uint8), -len(item), len(text))
        assert n == min(row) and row[end] == n


def test_html(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=x>Home</a></header><div class="cookie-notice">We use cookies, accept all of them now please.</div>
<article><h1>Head &amp; line</h1><p>First <b>bold</b>ed&nbsp;text,
 more of it.<p>Ok.</p><div class="ad">Buy now</div><script>var a="<p>no</p>";</script><p>Last one <a href=y>linked</a>.</p></article>
<section id="comments"><p>I liked this a lot, thank you for posting it today.</p></section><form><label>Name</label></form><footer>&copy; me</footer></body></html>"""
    d = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p>Cut off <a hr"), (5, "x", "no markup at all")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.extract_main_text(d).collect()}
    assert got[1].text == "Head & line First bolded text, more of it. Ok. Last one linked." and got[1].n_chars == len(got[1].text)
    assert [got[i].text for i in (2, 3, 4, 5)] == ["", "", "Cut off", "no markup at all"]
    assert html_text.extract_main_text(d.limit(0)).count() == 0


def labelled_docs(spark, n=400):
    texts, labels = [], []
    for i in range(n):
        bad, toxic = i % 4 == 0, i % 5 == 0
        t = prose(i, 150 + i)
        if bad:
            t = " ".join(w + "###" for w in t.split())
        if toxic:
            t += " you utter blockhead, such a blockhead " + prose(i + 1, 20)
        texts.append(t)
        labels.append((i, int(not bad), int(toxic)))
    return docs(spark, texts), spark.createDataFrame([*labels, (n + 5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_classifiers(spark):
    d, labels = labelled_docs(spark)
    more = d.unionByName(docs(spark, [None, ""], start=1000))
    model = quality.fit_quality(d, labels)
    got = quality.score_quality(more, model).toPandas()
    assert len(got) == 402 and got["score"].between(0, 1).all() and set(got.columns) == {"doc_id", "held_out", "score", "predicted"}
    out = got[(got.held_out) & (got.doc_id < 400)]
    assert (out["predicted"] == (out["doc_id"] % 4 != 0)).mean() > 0.97
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(got["doc_id"], got["held_out"]))
    kept = quality.quality_documents(d, model)
    assert kept.columns == d.columns and abs(kept.count() - 300) < 10
    tox = toxicity.score_toxicity(more, toxicity.fit_toxicity(d, labels)).toPandas()
    out = tox[(tox.held_out) & (tox.doc_id < 400)]
    assert (out["predicted"] == (out["doc_id"] % 5 == 0)).mean() > 0.97 and len(tox) == 402
    none = labels.limit(0)
    assert quality.score_quality(d, quality.fit_quality(d, none)).select("score").distinct().count() == 1
    assert toxicity.score_toxicity(d, toxicity.fit_toxicity(d, none)).count() == 400
    assert quality.score_quality(empty(spark), model).count() == 0


def test_sample_keeps_out_the_fold(spark):
    d, labels = labelled_docs(spark, 60)
    got = labelled.labelled_sample(d, labels, "toxic", 5, 0, True, 1000, 1 << 20).collect()
    assert got and all(zlib.crc32(str(r.doc_id).encode()) % 5 != 0 for r in got)


def test_packed_keys_and_counts():
    r = np.random.default_rng(2)
    for n, top in ((0, 5), (1, 1), (1, 2**56), (7, 8), (5000, 2**56), (3000, 4000)):
        keys = np.unique(r.integers(0, top, n, np.uint64))
        assert (ngram_lm.unpack(ngram_lm.pack(keys)) == keys).all()
    counts = np.array([1, 254, 255, 256, 10**12])
    assert (ngram_lm.unpack_counts(ngram_lm.pack_counts(counts)) == counts).all()


@pytest.mark.parametrize("order", [2, 3])
def test_language_model(spark, order, monkeypatch):
    monkeypatch.setattr(ngram_lm, "BLOCK_BYTES", 400)
    texts = [prose(i % 5, 30 + i) for i in range(12)] + ["the the the", "solo", None, "", "THE\nThe the"]
    got = {r.doc_id: r for r in ngram_lm.score_documents(docs(spark, texts), order).collect()}
    w = [words(t) for t in texts]
    total = sum(map(len, w))

    def count(doc_words):
        c = {}
        for k in range(order):
            for i in range(k, len(doc_words)):
                g = tuple(doc_words[i - k : i + 1])
                c[g] = c.get(g, 0) + 1
        return c

    own = [count(x) for x in w]
    every = {}
    for c in own:
        for g, n in c.items():
            every[g] = every.get(g, 0) + n
    for d, x in enumerate(w):
        left = lambda g: every[g] - own[d].get(g, 0)  # noqa: B023, E731
        s = 0.0
        for i in range(len(x)):
            back = 0.0
            for k in range(min(order - 1, i), -1, -1):
                g = tuple(x[i - k : i + 1])
                if k and left(g) > 0:
                    s += back + math.log(left(g)) - math.log(left(g[:-1]))
                    break
                if not k:
                    s += back + math.log(max(left(g), 0.5)) - math.log(total)
                back += math.log(0.4)
        assert got[d].n_words == len(x) and got[d].log_score == pytest.approx(s, abs=1e-6)
    assert ngram_lm.score_documents(empty(spark), order).count() == 0
    big = spark.createDataFrame([(2**53 + 1, "a b c"), (None, "a b d"), (2**53 + 3, None), (2**53 + 3, "a b c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_words) for r in ngram_lm.score_documents(big, order).collect()) == [(0, 3), (2**53 + 1, 3), (2**53 + 3, 0), (2**53 + 3, 3)]
    tables = ngram_lm.count_tables(docs(spark, texts), order).collect()
    assert sum(int(ngram_lm.unpack_counts(r["counts"]).sum()) for r in tables) == sum(every.values())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    d, labels = labelled_docs(spark, 60)
    items = [prose(900 + i, 30) for i in range(3)]
    extra = docs(spark, [prose(3, 160) + " " + items[0] + " " + prose(5, 100), prose(1, 151), prose(1, 151) + " more"], start=500)
    sf = str(tmp_path / "sf")
    d.unionByName(extra).write.parquet(f"{sf}/documents.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    at, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, sf)
        if k < 4:
            assert out.columns == at.columns
        out.write.parquet(f"{sf}/out{k}")
        at = spark.read.parquet(f"{sf}/out{k}")
        kept[k] = {r.doc_id for r in at.select("doc_id").collect()}
    assert 4 not in kept[0] and 500 in kept[0] and 502 not in kept[1] and 500 not in kept[2] and kept[4] == kept[3] <= kept[2]
    assert corpus_pipeline.run(spark, sf).count() == spark.read.parquet(f"{sf}/out3").count()
