"""A link scorer by logistic regression on products of the ends' vectors, its evaluation, and label transfer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import running_total


def link_features(labelled: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Labelled edges with features: the elementwise product of the ends' vectors (id, v)."""
    from pyspark.ml.functions import array_to_vector

    a = left.select(F.col("id").alias("src"), F.col("v").alias("va"))
    b = right.select(F.col("id").alias("dst"), F.col("v").alias("vb"))
    e = labelled.join(a, "src").join(b, "dst")
    return e.withColumn("features", array_to_vector(F.zip_with("va", "vb", lambda x, y: x.cast("double") * y.cast("double")))).drop("va", "vb")


def fit_link_scorer(features: DataFrame, steps: int = 50):
    """A distributed logistic regression on (features, label)."""
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(featuresCol="features", labelCol="label", maxIter=steps, regParam=1e-4).fit(features)


def evaluate(scored: DataFrame, cut: float = 0.5) -> DataFrame:
    """One row: auroc (ties shared) and f1 at the cut, from (label, score).

    Ranks come from counts per distinct score, so equal scores meet in a keyed sum and
    not in a sort of all rows.
    """
    k = scored.groupBy("score").agg(F.sum("label").cast("long").alias("p"), F.sum(1 - F.col("label")).cast("long").alias("n"))
    k = running_total(k, "score", "n", "upto").withColumn("below", F.col("upto") - F.col("n"))
    a = k.agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("u"), F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    hit = F.col("score") >= cut
    f = scored.agg(F.sum(F.when(hit & (F.col("label") == 1), 1).otherwise(0)).alias("tp"), F.sum(F.when(hit & (F.col("label") == 0), 1).otherwise(0)).alias("fp"), F.sum(F.when(~hit & (F.col("label") == 1), 1).otherwise(0)).alias("fn"))
    return a.crossJoin(f).select((F.col("u") / (F.col("pos") * F.col("neg"))).alias("auroc"), (2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"))


def bce_with_logits(z, label):
    """Loss per edge, stable for any logit."""
    return F.greatest(z, F.lit(0.0)) - z * label + F.log1p(F.exp(-F.abs(z)))


def transfer_labels(edges: DataFrame, reference: DataFrame) -> DataFrame:
    """(id, label): the majority label of the nearest neighbours (src, dst), ties to the smaller label."""
    k = edges.join(reference.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count("*").alias("k"))
    return k.groupBy(F.col("src").alias("id")).agg(F.max_by("label", F.struct("k", -F.col("label"))).alias("label"))
