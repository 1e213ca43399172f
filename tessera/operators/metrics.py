"""Validation metrics over long counts (cell_id, gene, n) and cells (cell_id, cell_type, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import save
from .ranks import quantiles


def _expression(counts: DataFrame, types: DataFrame) -> DataFrame:
    """(cell_type, gene, mean, share) over all cells of a type, cells without the gene as zeros."""
    size = types.groupBy("cell_type").agg(F.count("*").alias("cells"))
    s = counts.join(types.select("cell_id", "cell_type"), "cell_id").groupBy("cell_type", "gene").agg(F.sum("n").alias("s"), F.count("*").alias("k"))
    genes = counts.select("gene").distinct()
    full = size.crossJoin(F.broadcast(genes)).join(s, ["cell_type", "gene"], "left")  # types by panel: both bounded
    return full.select("cell_type", "gene", "cells", F.coalesce(F.col("s") / F.col("cells"), F.lit(0.0)).alias("mean"), F.coalesce(F.col("k") / F.col("cells"), F.lit(0.0)).alias("share"), F.coalesce("k", F.lit(0)).alias("k"))


def markers(counts: DataFrame, types: DataFrame, positive: float = 5, negative: float = 10, percentage: float = 50) -> DataFrame:
    """(cell_type, gene, marker): 'positive' from the percentile 100 - positive of the type's mean expressions on and in enough of its cells, 'negative' up to its percentile."""
    e = _expression(counts, types)
    cut = e.groupBy("cell_type").agg(F.percentile("mean", F.lit(1 - positive / 100)).alias("hi"), F.percentile("mean", F.lit(negative / 100)).alias("lo"))
    e = e.join(cut, "cell_type")
    kind = F.when((F.col("mean") >= F.col("hi")) & (F.col("share") * 100 >= percentage), "positive").when(F.col("mean") <= F.col("lo"), "negative")
    return e.withColumn("marker", kind).where("marker is not null").select("cell_type", "gene", "marker")


def exclusive_genes(counts: DataFrame, types: DataFrame, inside: float = 0.2, outside: float = 0.05) -> DataFrame:
    """(cell_type, gene): expressed by more than ``inside`` of a type and less than ``outside`` of the rest."""
    e = _expression(counts, types)
    total = e.groupBy("gene").agg(F.sum("k").alias("all_k"), F.sum("cells").alias("all_cells"))
    rest = (F.col("all_k") - F.col("k")) / (F.col("all_cells") - F.col("cells"))
    return e.join(total, "gene").where((F.col("share") > inside) & (rest < outside)).select("cell_type", "gene")


def exclusive_pairs(exclusive: DataFrame) -> DataFrame:
    """(gene1, gene2) exclusive to different types."""
    a, b = exclusive.alias("a"), exclusive.alias("b")
    return a.join(b, F.col("a.cell_type") < F.col("b.cell_type")).select(F.least("a.gene", "b.gene").alias("gene1"), F.greatest("a.gene", "b.gene").alias("gene2")).where("gene1 <> gene2").distinct()


def type_pairs(types: DataFrame) -> DataFrame:
    """(type1, type2): the pairs of different cell types, a bounded table."""
    c = types.select("cell_type").distinct()
    return c.select(F.col("cell_type").alias("type1")).join(F.broadcast(c.select(F.col("cell_type").alias("type2"))), F.col("type1") < F.col("type2"))


def mecr(counts: DataFrame, pairs: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(gene1, gene2, mecr): cells with both genes over cells with either, 0 if none has.  ``group``: cell columns in ``counts``.

    A cell's genes are one array; its genes and pairs of genes are counted where it stands, so only
    counts over a bounded panel are shuffled.
    """
    group = group or []
    cells = counts.where("n > 0").groupBy(*group, "cell_id").agg(F.sort_array(F.collect_set("gene")).alias("g"))
    heads = cells.select(*group, F.posexplode("g").alias("i", "a"), "g")
    both = heads.select(*group, "a", F.explode(F.expr("slice(g, i + 1, size(g))")).alias("b"))  # the gene itself, then those behind
    k = save(both.groupBy(*group, "a", "b").agg(F.count("*").alias("k")), "pair-counts")
    frame = pairs if not group else k.select(*group).distinct().crossJoin(F.broadcast(pairs))  # pairs of a bounded panel
    frame = frame.withColumn("a", F.least("gene1", "gene2")).withColumn("b", F.greatest("gene1", "gene2"))
    one = k.where("a = b")
    out = frame.join(k.withColumnRenamed("k", "k12"), [*group, "a", "b"], "left")
    for c, name in (("gene1", "k1"), ("gene2", "k2")):
        out = out.join(one.select(*group, F.col("a").alias(c), F.col("k").alias(name)), [*group, c], "left")
    out = out.na.fill(0, ["k1", "k2", "k12"])
    either = F.col("k1") + F.col("k2") - F.col("k12")
    return out.select(*group, "gene1", "gene2", F.when(either > 0, F.col("k12") / either).otherwise(F.lit(0.0)).alias("mecr"))


def quantile_bins(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """bin 1..bins by quantile edges, right-closed, the least value in the first bin."""
    edges = quantiles(df, column, [i / bins for i in range(1, bins)])
    below = sum((F.when(F.col(column) > F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))
    return df.withColumn("bin", below + 1)


def mecr_by_quantile(counts: DataFrame, pairs: DataFrame, cells: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """quantile, average_mecr, variance_mecr, average of the column, num_cells."""
    binned = quantile_bins(cells.select("cell_id", column), column, bins)
    size = binned.groupBy("bin").agg(F.avg(column).alias("average"), F.count("*").alias("num_cells"))
    m = mecr(counts.join(binned.select("cell_id", "bin"), "cell_id"), pairs, ["bin"]).groupBy("bin").agg(F.avg("mecr").alias("average_mecr"), F.var_pop("mecr").alias("variance_mecr"))
    return size.join(m, "bin", "left").select((F.col("bin") / bins).alias("quantile"), "average_mecr", "variance_mecr", "average", "num_cells")


def contamination(counts: DataFrame, types: DataFrame, marker_table: DataFrame, edges: DataFrame, clean: bool = False) -> DataFrame:
    """(source_type, target_type, contamination) for all pairs of types with positive markers.

    D(c, m) is the count of marker m in a cell c and its neighbours.  For every cell c, each
    marker m of its type with D(c, m) > 0 (the outer one), each neighbour of another
    type and each marker m' of the cell's type that is none of the neighbour's (the inner one), a
    term is the neighbour's count of m' over D(c, m): every inner term is added once per
    outer marker.  The result is the sum of the terms over their number plus one.  ``clean``: one
    term per inner marker, over its own D(c, m').
    """
    pos = marker_table.where("marker = 'positive'").select("cell_type", "gene").distinct()
    t = types.select("cell_id", "cell_type").join(F.broadcast(pos.select("cell_type").distinct()), "cell_type", "left_semi")
    src = t.select(F.col("cell_id").alias("src"), F.col("cell_type").alias("source_type"))
    link = edges.select("src", "dst")
    near = link.unionByName(src.select("src", F.col("src").alias("dst")))
    around = near.join(src, "src").join(counts.select(F.col("cell_id").alias("dst"), "gene", "n"), "dst").join(F.broadcast(pos.withColumnRenamed("cell_type", "source_type")), ["source_type", "gene"], "left_semi")
    around = around.groupBy("src", "gene").agg(F.sum("n").alias("d")).where("d > 0")
    # markers of one type that are none of another: types by types by panel, all bounded
    names = pos.select(F.col("cell_type").alias("target_type")).distinct()
    inner = pos.withColumnRenamed("cell_type", "source_type").crossJoin(F.broadcast(names)).where("source_type <> target_type")
    inner = inner.join(pos.withColumnRenamed("cell_type", "target_type"), ["target_type", "gene"], "left_anti")
    across = link.join(src, "src").join(t.select(F.col("cell_id").alias("dst"), F.col("cell_type").alias("target_type")), "dst").where("source_type <> target_type")
    held = across.join(F.broadcast(inner), ["source_type", "target_type"]).join(counts.select(F.col("cell_id").alias("dst"), "gene", "n"), ["dst", "gene"], "left")
    if clean:
        terms = held.join(around, ["src", "gene"]).select("source_type", "target_type", (F.coalesce("n", F.lit(0)) / F.col("d")).alias("s"), F.lit(1).alias("k"))
    else:
        outer = around.groupBy("src").agg(F.sum(1 / F.col("d")).alias("inverse"), F.count("*").alias("outer"))
        held = held.groupBy("src", "dst", "source_type", "target_type").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.count("*").alias("inner"))
        terms = held.join(outer, "src").select("source_type", "target_type", (F.col("n") * F.col("inverse")).alias("s"), (F.col("inner") * F.col("outer")).alias("k"))
    sums = terms.groupBy("source_type", "target_type").agg(F.sum("s").alias("s"), F.sum("k").alias("k"))
    frame = names.select(F.col("target_type").alias("source_type")).crossJoin(F.broadcast(names))
    return frame.join(sums, ["source_type", "target_type"], "left").select("source_type", "target_type", (F.coalesce("s", F.lit(0.0)) / (F.coalesce("k", F.lit(0)) + 1)).alias("contamination"))


def sensitivity(counts: DataFrame, types: DataFrame, marker_table: DataFrame, max_cells: int = 1000) -> DataFrame:
    """(cell_id, cell_type, sensitivity): expressed positive markers over the type's, for at most ``max_cells`` per type, the first by hash."""
    pos = marker_table.where("marker = 'positive'").select("cell_type", "gene")
    size = pos.groupBy("cell_type").agg(F.count("*").alias("m"))
    w = Window.partitionBy("cell_type").orderBy(F.md5(F.col("cell_id").cast("string")), "cell_id")
    some = types.select("cell_id", "cell_type").withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_cells).drop("r")
    hit = counts.where("n > 0").join(some, "cell_id").join(F.broadcast(pos), ["cell_type", "gene"]).groupBy("cell_id").agg(F.count("*").alias("k"))
    return some.join(F.broadcast(size), "cell_type").join(hit, "cell_id", "left").select("cell_id", "cell_type", (F.coalesce("k", F.lit(0)) / F.col("m")).alias("sensitivity"))


def runs(rows: DataFrame, key: str, value: str, width: int) -> DataFrame:
    """One row: runs of equal values in the order of an integer key, counted in key ranges of ``width`` and over their ends."""
    b = rows.select(F.expr(f"{key} div {width}").alias("b"), key, value)
    b = b.withColumn("p", F.lag(value).over(Window.partitionBy("b").orderBy(key)))
    b = b.groupBy("b").agg(F.sum(F.when(F.col("p") != F.col(value), 1).otherwise(0)).alias("inside"), F.min_by(value, key).alias("first"), F.max_by(value, key).alias("last"))
    b = b.withColumn("before", F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy("b")))  # one row per range
    new = F.when(F.col("before").isNull() | (F.col("before") != F.col("first")), 1).otherwise(0)
    return b.agg(F.sum(F.col("inside") + new).alias("runs"))


def calinski_harabasz(points: DataFrame, dims: list[str], label: str) -> DataFrame:
    """One row: between over within dispersion, from group sums."""
    sums = points.groupBy(label).agg(F.count("*").alias("n"), *(F.avg(d).alias(f"m_{d}") for d in dims), *(F.var_pop(d).alias(f"v_{d}") for d in dims))
    grand = points.agg(F.count("*").alias("total"), *(F.avg(d).alias(f"g_{d}") for d in dims))
    within = sum((F.col(f"v_{d}") * F.col("n") for d in dims), F.lit(0.0))
    between = sum((F.pow(F.col(f"m_{d}") - F.col(f"g_{d}"), 2) * F.col("n") for d in dims), F.lit(0.0))
    a = sums.crossJoin(F.broadcast(grand)).agg(F.sum(within).alias("w"), F.sum(between).alias("b"), F.count("*").alias("k"), F.max("total").alias("total"))
    return a.select(((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("total") - F.col("k")))).alias("calinski_harabasz"))


def silhouette(points: DataFrame, dims: list[str], label: str) -> DataFrame:
    """One row: mean silhouette with squared distances, from each group's sums alone (linear in the points)."""
    g = points.groupBy(F.col(label).alias("g")).agg(F.count("*").alias("n"), *(F.sum(d).alias(f"s_{d}") for d in dims), F.sum(sum((F.col(d) * F.col(d) for d in dims[1:]), F.col(dims[0]) * F.col(dims[0]))).alias("q"))
    p = points.withColumn("__id", F.monotonically_increasing_id()).crossJoin(F.broadcast(g))  # one row per group
    norm = sum((F.col(d) * F.col(d) for d in dims[1:]), F.col(dims[0]) * F.col(dims[0]))
    cross = sum((F.col(d) * F.col(f"s_{d}") for d in dims[1:]), F.col(dims[0]) * F.col(f"s_{dims[0]}"))
    total = norm * F.col("n") + F.col("q") - 2 * cross
    own = F.col(label) == F.col("g")
    p = p.groupBy("__id").agg(F.max(F.when(own & (F.col("n") > 1), total / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, total / F.col("n"))).alias("b"))
    s = F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return p.agg(F.avg(s).alias("silhouette"))


def neighbourhood_entropy(edges: DataFrame, types: DataFrame) -> DataFrame:
    """(cell_id, neighbours, entropy) of neighbours' types, natural logarithm."""
    k = edges.join(types.select(F.col("cell_id").alias("dst"), "cell_type"), "dst").groupBy("src", "cell_type").agg(F.count("*").alias("k"))
    n = k.withColumn("n", F.sum("k").over(Window.partitionBy("src"))).withColumn("p", F.col("k") / F.col("n"))
    return n.groupBy(F.col("src").alias("cell_id")).agg(F.max("n").alias("neighbours"), (-F.sum(F.col("p") * F.log("p"))).alias("entropy"))


def percent_assigned(points: DataFrame) -> DataFrame:
    """(method, gene, percent): a method's assigned points of a gene over the most any method has."""
    k = points.groupBy("method", "gene").agg(F.count("cell_id").alias("k"))
    top = F.max("k").over(Window.partitionBy("gene"))
    return k.select("method", "gene", F.when(top > 0, F.col("k") / top * 100).otherwise(F.lit(0.0)).alias("percent"))


def density(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell_id, density, log_density): points per area of a cell."""
    s = counts.groupBy("cell_id").agg(F.sum("n").alias("s")).join(cells.select("cell_id", "area"), "cell_id")
    return s.select("cell_id", (F.col("s") / F.col("area")).alias("density"), F.log2(F.col("s") / F.col("area") + 1).alias("log_density"))


def average_expression(counts: DataFrame, types: DataFrame) -> DataFrame:
    """(cell_type, gene, mean_n) over the cells of a type that have the gene."""
    return counts.join(types.select("cell_id", "cell_type"), "cell_id").groupBy("cell_type", "gene").agg(F.avg("n").alias("mean_n"))


def method_cells(points: DataFrame) -> DataFrame:
    """(method, cell_id, counts): a method's points of each cell plus one."""
    return points.where("cell_id is not null").groupBy("method", "cell_id").agg((F.count("*") + 1).alias("counts"))


def method_summary(points: DataFrame) -> DataFrame:
    """(method, cells, median_counts): cells that a method has, and the median of their points plus one (whole numbers, few distinct)."""
    return method_cells(points).groupBy("method").agg(F.count("*").alias("cells"), F.percentile("counts", F.lit(0.5)).alias("median_counts"))


def normalised_gene_counts(points: DataFrame) -> DataFrame:
    """(method, gene, share): a method's assigned points of a gene over the most any method has; null where none has any."""
    k = points.groupBy("method", "gene").agg(F.count("cell_id").alias("k"))
    top = F.max("k").over(Window.partitionBy("gene"))
    return k.select("method", "gene", F.when(top > 0, F.col("k") / top).alias("share"))


def method_areas(cells: DataFrame, counts: DataFrame) -> DataFrame:
    """(cell_id, area_plus_one, log_density): what the area and density plots show."""
    return density(counts, cells).join(cells.select("cell_id", (F.col("area") + 1).alias("area_plus_one")), "cell_id").select("cell_id", "area_plus_one", "log_density")


def compare_methods(a: DataFrame, b: DataFrame, on: str, value: str) -> DataFrame:
    """Two methods' values side by side."""
    return a.select(on, F.col(value).alias(f"{value}_1")).join(b.select(on, F.col(value).alias(f"{value}_2")), on)


def purity_f1(truth: DataFrame) -> DataFrame:
    """Per cell type, F1 of predicted against true type (columns cell_type, predicted)."""
    tp = truth.where("cell_type = predicted").groupBy("cell_type").agg(F.count("*").alias("tp"))
    t = truth.groupBy("cell_type").agg(F.count("*").alias("t"))
    p = truth.groupBy(F.col("predicted").alias("cell_type")).agg(F.count("*").alias("p"))
    return t.join(p, "cell_type", "left").join(tp, "cell_type", "left").select("cell_type", (2 * F.coalesce("tp", F.lit(0)) / (F.col("t") + F.coalesce("p", F.lit(0)))).alias("f1"))
