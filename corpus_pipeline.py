"""The corpus pipeline: five stages over ``documents``, each written and read again as the next one's input.

1. quality classifier: documents that it rejects go;
2. n-gram Jaccard join (five words, similarity 0.8): of each group the smallest doc_id stays;
3. benchmark decontamination: documents that hold a benchmark item go;
4. mixing sources to target weights: documents in whole copies by their source's quota;
5. token-ID output: binary token files, described per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common, decontaminate, jaccard, mixing, quality, token_files


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Labels are learned from the whole of ``documents``; the model judges ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_documents(docs, quality.fit_quality(docs, labels))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.near_distinct_documents(docs, n=5, num=4, den=5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.token_output(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", token_stage),
]

#: A trained classifier, alignment and a tokenizer are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.save(docs, f"stage{i}")
    return docs
