"""Python workers outlive their tasks: what they hold after an operator's last task."""

import random
import re

import public_tokenizers

from tessera.llm import jaccard, token_files


def _workers(spark):
    """Per task of a probe: its worker, the encoders that it remembers, and its MB besides files."""

    def probe(it):
        import os
        import time

        import pyarrow as pa

        for _ in it:
            pass
        time.sleep(0.5)  # so that each worker has a task
        with open("/proc/self/smaps_rollup") as f:
            mb = sum(map(int, re.findall(r"\nPrivate_(?:Clean|Dirty):\s+(\d+)", f.read()))) // 1024
        yield pa.record_batch([pa.array([os.getpid()]), pa.array([token_files._coder.cache_info().currsize]), pa.array([mb])], names=["pid", "coders", "mb"])

    return spark.range(8).repartition(8).mapInArrow(probe, "pid long, coders long, mb long").collect()


def test_workers_forget_other_operators_and_give_memory_back(spark):
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(20_000)]
    docs = spark.createDataFrame([(i, " ".join(r.choices(words, k=4000))) for i in range(1200)], "doc_id long, text string").repartition(4).cache()
    docs.count()
    token_files.token_output(docs, public_tokenizers.path("byte_bpe_50k.json")).count()
    assert any(w["coders"] for w in _workers(spark))  # its own next task needs them
    assert jaccard.near_distinct_documents(docs).count() == 1200
    after = _workers(spark)
    docs.unpersist()
    assert not any(w["coders"] for w in after)
    assert max(w["mb"] for w in after) < 130
