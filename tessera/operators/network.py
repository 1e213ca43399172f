"""A graph attention network over points and outlines: its forward pass as joins, keyed sums and Arrow-batched products.

Points hear from neighbouring points (tx_tx), outlines from points (tx_bd).  Every layer
has, per edge type, a source and a target projection, an attention vector per head and a
bias; heads stand side by side.  Weights are small matrices that travel with the code;
features are arrays in columns, so a layer is two joins on edges, a maximum, and a sum
per target, and nothing but the edges' rows is shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import link_score
from ..sources.storage import save

TYPES = ("tx_tx", "tx_bd")


def token_features(df: DataFrame, column: str) -> bool:
    """Whether a feature column holds tokens (whole numbers) and not vectors."""
    return dict(df.dtypes)[column] in ("tinyint", "smallint", "int", "bigint")


def random_weights(n_tokens: int, n_dense: int, init: int = 16, hidden: int = 32, middle: int = 3, out: int = 32, heads: int = 3, seed: int = 0) -> dict:
    """Weights of an untrained network: embedding, lin0 and 1 + middle + 1 layers."""
    r = np.random.default_rng(seed)
    layers, width = [], init
    for c in [hidden] * (1 + middle) + [out]:
        layer = {}
        for kind in TYPES:
            scale = (6 / (width + heads * c)) ** 0.5
            layer[kind] = {"left": r.uniform(-scale, scale, (heads * c, width)), "left_bias": np.zeros(heads * c), "right": r.uniform(-scale, scale, (heads * c, width)), "right_bias": np.zeros(heads * c), "att": r.uniform(-1, 1, (heads, c)) / c**0.5, "bias": np.zeros(heads * c)}
        layers.append(layer)
        width = heads * c
    return {"embedding": r.normal(0, 1, (n_tokens, init)), "lin0": r.uniform(-1, 1, (init, n_dense)) / max(1, n_dense) ** 0.5, "layers": layers}


def _linear(weight: np.ndarray, bias: np.ndarray | None, h: Column) -> Column:
    @F.pandas_udf("array<double>")
    def product(x: pd.Series) -> pd.Series:
        y = np.stack(x.to_numpy()).astype(float) @ weight.T + (0 if bias is None else bias) if len(x) else np.zeros((0, len(weight)))
        return pd.Series(list(y))

    return product(h)


def _logits(att: np.ndarray, slope: float, left: Column, right: Column) -> Column:
    heads, c = att.shape

    @F.pandas_udf("array<double>")
    def logit(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        z = np.stack(x.to_numpy()) + np.stack(y.to_numpy())
        z = np.where(z > 0, z, slope * z).reshape(len(x), heads, c)
        return pd.Series(list((z * att).sum(2)))

    return logit(left, right)


def attention(source: DataFrame, target: DataFrame, edges: DataFrame, w: dict, slope: float = 0.2) -> DataFrame:
    """(id, h) of all ``target`` nodes: per head the attention-weighted sum of the sources' projections; the bias alone where no edge ends."""
    heads, c = w["att"].shape
    left = source.select(F.col("id").alias("src"), _linear(w["left"], w["left_bias"], F.col("h")).alias("l"))
    right = target.select(F.col("id").alias("dst"), _linear(w["right"], w["right_bias"], F.col("h")).alias("r"))
    e = edges.select("src", "dst").join(left, "src").join(right, "dst")
    e = save(e.select("dst", "l", _logits(w["att"], slope, F.col("l"), F.col("r")).alias("z")), "attention")
    top = e.groupBy("dst").agg(*(F.max(F.col("z")[k]).alias(f"t{k}") for k in range(heads)))
    e = e.join(top, "dst").select("dst", "l", *(F.exp(F.col("z")[k] - F.col(f"t{k}")).alias(f"e{k}") for k in range(heads)))
    sums = e.groupBy("dst").agg(*(F.sum(f"e{k}").alias(f"s{k}") for k in range(heads)), *(F.sum(F.col(f"e{i // c}") * F.col("l")[i]).alias(f"m{i}") for i in range(heads * c)))
    out = F.array(*(F.coalesce(F.col(f"m{i}") / F.col(f"s{i // c}"), F.lit(0.0)) + float(w["bias"][i]) for i in range(heads * c)))
    return target.select(F.col("id").alias("dst")).join(sums, "dst", "left").select(F.col("dst").alias("id"), out.alias("h"))


def forward(tx: DataFrame, bd: DataFrame, tx_tx: DataFrame, tx_bd: DataFrame, weights: dict) -> tuple[DataFrame, DataFrame]:
    """Embeddings (id, h) of points and outlines, saved.

    ``tx``: id and x, a token or a vector; ``bd``: id and x, a vector.  NaN counts as 0.
    """

    def start(nodes: DataFrame) -> DataFrame:
        relu = lambda h: F.transform(h, lambda v: F.greatest(v, F.lit(0.0)))
        if token_features(nodes, "x"):
            table = weights["embedding"]

            @F.pandas_udf("array<double>")
            def embed(x: pd.Series) -> pd.Series:
                return pd.Series(list(table[x.to_numpy(np.int64)]))

            return nodes.select("id", relu(embed("x")).alias("h"))
        clean = F.transform("x", lambda v: F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0)))
        return nodes.select("id", relu(_linear(weights["lin0"], None, clean)).alias("h"))

    a, b = save(start(tx), "layer"), save(start(bd), "layer")
    for k, layer in enumerate(weights["layers"]):
        last = k == len(weights["layers"]) - 1
        act = (lambda df: df) if last else (lambda df: df.withColumn("h", F.transform("h", lambda v: F.greatest(v, F.lit(0.0)))))
        a, b = save(act(attention(a, a, tx_tx, layer["tx_tx"])), "layer"), save(act(attention(a, b, tx_bd, layer["tx_bd"])), "layer")
    return a, b


def network_scores(tx: DataFrame, bd: DataFrame):
    """A score for edges (src, dst) from embeddings: the sigmoid of the dot product of the ends."""
    from .graph import similarity

    a, b = (df.select("id", F.col("h").alias("v")) for df in (tx, bd))
    return lambda edges: similarity(edges, a, b)


__all__ = ["attention", "forward", "link_score", "network_scores", "random_weights", "token_features"]
