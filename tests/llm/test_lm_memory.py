"""The trigram model's tasks hold the occurrences of one order at a time, and give back what they used."""

import random
import re
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard

from tessera.llm import ngram_lm


def test_scoring_a_block_holds_one_order_at_a_time():
    r = random.Random(2)
    texts = [" ".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=1000)) for _ in range(400)]
    sizes, packed = [len(t) for t in texts], zstandard.compress("".join(texts).encode())
    block = pa.record_batch([pa.array([0]), pa.array([sizes], pa.list_(pa.int64())), pa.array([packed], pa.binary())], names=["block", "sizes", "texts"])
    asked = pa.Table.from_batches(ngram_lm._ask(3, 4)([block])).to_pandas()
    blocks = pd.DataFrame({"block": [0], "ids": [np.arange(400)], "nameless": [np.zeros(0, np.int64)], "sizes": [np.array(sizes)], "texts": [packed]})
    score = ngram_lm._score(3, 400_000)
    tracemalloc.start()
    try:
        got = score(blocks, asked[["block", "bucket", "counts"]])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (got["n_words"] == 1000).all()
    assert peak < 180 * 400_000


def test_workers_give_memory_back_after_scoring(spark):
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(20_000)]
    docs = spark.createDataFrame([(i, " ".join(r.choices(words, k=4000))) for i in range(1600)], "doc_id long, text string").repartition(4).cache()
    docs.count()
    assert ngram_lm.score_documents(docs, 3).count() == 1600

    def probe(it):
        import time

        for _ in it:
            pass
        time.sleep(0.5)  # so that each worker has a task
        with open("/proc/self/smaps_rollup") as f:
            yield pa.record_batch([pa.array([sum(map(int, re.findall(r"\nPrivate_(?:Clean|Dirty):\s+(\d+)", f.read()))) // 1024])], names=["mb"])

    after = spark.range(8).repartition(8).mapInArrow(probe, "mb long").collect()
    docs.unpersist()
    assert max(w["mb"] for w in after) < 130
