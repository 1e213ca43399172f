"""Cell by gene counts in long form, and summaries of cells, genes and assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import quantiles, running_total


def counts(points: DataFrame, min_points: int = 0) -> DataFrame:
    """(cell_id, gene, n) of assigned points, of cells with at least ``min_points``."""
    out = points.where("cell_id is not null").groupBy("cell_id", "gene").agg(F.count("*").alias("n"))
    if min_points:
        out = out.withColumn("__t", F.sum("n").over(Window.partitionBy("cell_id"))).where(F.col("__t") >= min_points).drop("__t")
    return out


def pivoted(counts: DataFrame, genes: list[str]) -> DataFrame:
    """Wide counts of named genes, 0 where none: for presentation."""
    return counts.groupBy("cell_id").pivot("gene", genes).agg(F.sum("n")).na.fill(0)


def cell_summary(points: DataFrame, hulls: bool = False) -> DataFrame:
    """cell_id, centroid, transcripts, unique genes; with ``hulls`` also hull_area of the points."""
    out = points.where("cell_id is not null").groupBy("cell_id").agg(F.avg("x").alias("cell_centroid_x"), F.avg("y").alias("cell_centroid_y"), F.count("*").alias("transcripts"), F.countDistinct("gene").alias("unique_transcripts"))
    if not hulls:
        return out
    from .shapes import point_hulls

    return out.join(point_hulls(points), "cell_id")


def gene_counts(points: DataFrame, panel: DataFrame | None = None) -> DataFrame:
    """gene, total_assigned, total_unassigned; panel genes that are missing get 0."""
    out = points.groupBy("gene").agg(F.count("cell_id").alias("total_assigned"), F.count(F.when(F.col("cell_id").isNull(), 1)).alias("total_unassigned"))
    return out if panel is None else panel.select("gene").join(out, "gene", "left").na.fill(0, ["total_assigned", "total_unassigned"])


def transcript_metrics(points: DataFrame, qv_threshold: float = 30) -> DataFrame:
    """One row of percentages over points with qv > threshold; denominators are one larger than the counts."""
    good = points.where(F.col("qv") > qv_threshold)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    inside, taken = F.col("nuclear") == 1, F.col("cell_id").isNotNull()
    a = good.agg(F.count("*").alias("all"), n(taken).alias("assigned"), n(taken & inside).alias("nuclear"), n(taken & ~inside).alias("cyto"), n(~inside).alias("outside"), n(~inside & ~taken).alias("free"))
    p = lambda x, y: (F.col(x) / (F.col(y) + 1) * 100)
    return a.select(p("assigned", "all").alias("percent_assigned"), p("cyto", "assigned").alias("percent_cytoplasmic"), p("nuclear", "assigned").alias("percent_nucleus"), p("free", "outside").alias("percent_non_assigned_cytoplasmic"))


def gene_metrics(points: DataFrame, qv_threshold: float = 30) -> DataFrame:
    """gene, percent_assigned, percent_cytoplasmic (of assigned); an outer merge with 0 for the missing."""
    good = points.where(F.col("qv") > qv_threshold)
    every = good.groupBy("gene").agg(F.count("*").alias("t"), F.count("cell_id").alias("a"))
    cyto = good.where("cell_id is not null and nuclear <> 1").groupBy("gene").agg(F.count("*").alias("c"))
    total = good.where("cell_id is not null and nuclear <> 1").agg(F.count("*").alias("tc"))
    out = every.select("gene", (F.col("a") / (F.col("t") + 1) * 100).alias("percent_assigned")).join(cyto.crossJoin(F.broadcast(total)).select("gene", (F.col("c") / (F.col("tc") + 1) * 100).alias("percent_cytoplasmic")), "gene", "full_outer")
    return out.na.fill(0.0)


def abundance(counts: DataFrame, types: DataFrame) -> DataFrame:
    """(gene, cell_type, abundance): share of a type's cells that express a gene, cells without counts included."""
    size = types.groupBy("cell_type").agg(F.count("*").alias("cells"))
    hit = counts.where("n > 0").join(types.select("cell_id", "cell_type"), "cell_id").groupBy("gene", "cell_type").agg(F.count("*").alias("k"))
    return hit.join(F.broadcast(size), "cell_type").select("gene", "cell_type", (F.col("k") / F.col("cells")).alias("abundance"))


def cluster_medians(counts: DataFrame, types: DataFrame, genes: list[str]) -> DataFrame:
    """(cell_type, gene, median) over all cells of a type, zeros included, for a fixed panel."""
    panel = types.sparkSession.createDataFrame([(g,) for g in genes], "gene string")
    full = types.select("cell_id", "cell_type").crossJoin(F.broadcast(panel)).join(counts, ["cell_id", "gene"], "left")
    return full.groupBy("cell_type", "gene").agg(F.percentile(F.coalesce("n", F.lit(0)), F.lit(0.5)).alias("median"))


def gene_percentiles(points: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """gene and p<percent> of a column over the gene's points."""
    return points.groupBy("gene").agg(*(F.percentile(column, F.lit(s)).alias(f"p{round(s * 100)}") for s in shares))


def top_genes(counts: DataFrame, n_cells: int, k: int = 30) -> DataFrame:
    """The k genes of greatest mean count; ties by name."""
    return counts.groupBy("gene").agg((F.sum("n") / F.lit(n_cells)).alias("mean_n")).orderBy(F.desc("mean_n"), "gene").limit(k)


def csr(counts: DataFrame, row: str, column: str) -> DataFrame:
    """Compressed rows: (row, indptr_begin, indptr_end, indices): running offsets over the rows' sizes."""
    size = counts.groupBy(row).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(column)).alias("indices"))
    return running_total(size, row, "n", "end").select(row, (F.col("end") - F.col("n")).alias("indptr_begin"), F.col("end").alias("indptr_end"), "indices")


def tuning_metrics(points: DataFrame) -> DataFrame:
    """Share of points assigned; mean size of cells that are no fragments, and of fragments."""
    cells = points.where("cell_id is not null").groupBy("cell_id").agg(F.count("*").alias("n"))
    nx = F.col("cell_id").cast("string").endswith("-nx")
    sizes = cells.agg(F.avg(F.when(~nx, F.col("n"))).alias("mean_cell_size"), F.avg(F.when(nx, F.col("n"))).alias("mean_fragment_size"))
    return points.agg((F.count("cell_id") / F.count("*")).alias("frac_assigned")).crossJoin(sizes)


def neighbour_parameters(areas: DataFrame, points: DataFrame, outline_area: float) -> DataFrame:
    """Search radius (a quarter of the median diameter) and k (points in that disc at the 90th percentile of density)."""
    import math

    (diameter,) = quantiles(areas.select((2 * F.sqrt(F.col("area") / math.pi)).alias("d")), "d", [0.5])
    density = points.where("cell_id is not null").groupBy("cell_id").agg((F.count("*") / F.lit(outline_area)).alias("d"))
    (d90,) = quantiles(density, "d", [0.9])
    dist = None if diameter is None else diameter / 4
    k = None if dist is None or d90 is None else math.ceil(math.pi * dist * dist * d90)
    return points.sparkSession.createDataFrame([(dist, k)], "dist_tx double, k_tx long")
