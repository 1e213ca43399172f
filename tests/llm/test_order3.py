"""The registered trigram model."""

import pytest

from tessera.llm import ngram_lm, queries


def test_registered_trigram_model_reads_longer_context(spark, tmp_path):
    texts = ["a b c d", "a b c e", "x b c d", "a b c d a b", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.log_score for r in queries.QUERIES["op7_lm_scoring"](spark, str(tmp_path)).collect()}
    want = {n: {r.doc_id: r.log_score for r in ngram_lm.score_documents(df, n).collect()} for n in (2, 3)}
    assert got == pytest.approx(want[3], abs=1e-3)
    assert any(abs(got[i] - want[2][i]) > 0.01 for i in got)
