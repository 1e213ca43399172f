"""A labelled sample is few rows, so it is written to few files, whatever the number of shuffle partitions."""

from pyspark.sql import functions as F

from tessera.llm import labelled

HOT = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "16k"}


def test_sample_is_written_to_few_files(spark, tmp_path, monkeypatch):
    n = 2000
    ids = spark.range(n).select(F.col("id").alias("doc_id"))
    docs = ids.withColumn("text", F.concat(F.lit("text "), "doc_id")).unionAll(ids.withColumn("text", F.concat(F.lit("text "), "doc_id")))
    rows = ids.withColumn("quality", (F.col("doc_id") % 2).cast("int"))
    docs.write.parquet(f"{tmp_path}/docs")
    rows.write.parquet(f"{tmp_path}/labels")
    files = []
    saved = labelled.save

    def counted(df, name):
        out = saved(df, name)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(labelled, "save", counted)
    old = {k: spark.conf.get(k) for k in HOT}
    try:
        for k, v in HOT.items():
            spark.conf.set(k, v)
        got = labelled.labelled_sample(spark.read.parquet(f"{tmp_path}/docs"), spark.read.parquet(f"{tmp_path}/labels"), "quality", 3, 1, True, 4000, 32 << 20).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = {r.doc_id for r in ids.where(labelled.fold_of(F.col("doc_id"), 3) != 1).collect()}
    assert len(got) == len(want) and {r.doc_id for r in got} == want and all(r.text == f"text {r.doc_id}" and r.y == r.doc_id % 2 for r in got)
    assert max(files) <= labelled.FILES, files
