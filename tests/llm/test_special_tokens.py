"""The registered encoding is the library's own call, strings of special tokens included."""

import zlib

import numpy as np


def test_registered_queries_encode_as_the_library(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from tessera.llm import queries

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one <|endoftext|> two", "a<|endoftext|>b", "plain words", "<|endoftext|>", "日本<|endoftext|> x", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    last = corpus_pipeline.STAGES[-1][1]
    for out in (queries.QUERIES["op10_token_output"](spark, str(tmp_path)), last(spark, docs, str(tmp_path))):
        got, at = {r.doc_id: r for r in out.collect()}, 0
        for i, t in enumerate(texts):
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
            assert t is None or "<|" not in t or 50256 in ids
            assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += len(ids)
