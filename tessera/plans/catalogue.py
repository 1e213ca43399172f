"""Named queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, ids, vectors
from ..operators import components, filters, graph, learn, matrix, metrics, shapes, spatial_join, tiling
from ..sources import readers, sinks
from . import dataset, segment
from .fixtures import PREFIXES, oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The fixture views of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    tx = property(lambda self: view(self.spark, self.dir, "v_transcripts"))
    bd = property(lambda self: view(self.spark, self.dir, "v_boundaries"))
    cells = property(lambda self: view(self.spark, self.dir, "v_cells"))
    assigned = property(lambda self: view(self.spark, self.dir, "v_assignments"))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def points(self) -> DataFrame:
        return self.tx.select(F.col("transcript_id").alias("id"), "x", "y", "z")

    @property
    def counts(self) -> DataFrame:
        return matrix.counts(self.tx)

    @property
    def centres(self) -> DataFrame:
        return segment.outline_centres(self.bd)

    @property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def query(name: str, sql: str | None = None):
    """Register a query of a Tables object; ``sql`` runs over the views of fixtures."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = oracle(sql)
        return f

    return add


R = lambda c, k=6: F.round(F.col(c) if isinstance(c, str) else c, k)
COUNTS = "(select cell_id, gene, count(*) as n from v_transcripts where cell_id is not null group by cell_id, gene)"

# -- scans ------------------------------------------------------------------------------------


@query("q_extents", "select round(least((select min(x) from v_transcripts), (select min(x) from v_boundaries)), 6) as xmin, round(least((select min(y) from v_transcripts), (select min(y) from v_boundaries)), 6) as ymin, round(greatest((select max(x) from v_transcripts), (select max(x) from v_boundaries)), 6) as xmax, round(greatest((select max(y) from v_transcripts), (select max(y) from v_boundaries)), 6) as ymax")
def _(t):
    return readers.joint_extents(t.tx, t.bd).select(*(R(c).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))


@query("q_region_scan", "select transcript_id, gene from v_transcripts where x > 100 and x < 300 and y > 100 and y < 300 and qv >= 20")
def _(t):
    return readers.region(t.tx, (100, 100, 300, 300), F.col("qv") >= 20, columns=["transcript_id", "gene"])


@query("q_region_closed", "select transcript_id, gene from v_transcripts where x between 100 and 300 and y between 100 and 300 and nuclear = 1")
def _(t):
    return readers.region(t.tx, (100, 100, 300, 300), F.col("nuclear") == 1, closed=True, columns=["transcript_id", "gene"])


@query("q_metadata", "select count(*) as n_rows, cast(4 as bigint) as n_columns, cast(32 as bigint) as row_bytes from v_transcripts")
def _(t):
    return readers.metadata(t.tx, ["transcript_id", "x", "y", "gene"])


@query("q_boundary_metadata", "select count(*) as n_vertices, count(distinct cell_id) as n_outlines from v_boundaries")
def _(t):
    return t.bd.agg(F.count("*").alias("n_vertices"), F.countDistinct("cell_id").alias("n_outlines"))


@query("q_distinct_features", "select distinct gene from v_transcripts where not (starts_with(gene, 'NegControlProbe_') or starts_with(gene, 'BLANK_'))")
def _(t):
    return readers.features(t.tx, PREFIXES)


@query("q_set_metadata", "select round(min(x), 6) as xmin, round(min(y), 6) as ymin, round(max(x), 6) as xmax, round(max(y), 6) as ymax, count(*) as n_rows, count(distinct gene) as n_genes from v_transcripts")
def _(t):
    return readers.set_metadata(t.tx).select(*(R(c).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")), "n_rows", "n_genes")


_FRAGMENTED = "case when method = 'A' then cast(cell_id as varchar) || '-nx' else cast(cell_id as varchar) end"


@query("q_split_methods", f"select case when {_FRAGMENTED} like '%-nx' then 'm_n0' else 'm_n1' end as method_part, count(*) as n from v_transcripts where cell_id is not null group by 1")
def _(t):
    c = F.col("cell_id").cast("string")
    tx = t.tx.where("cell_id is not null").withColumn("cell_id", F.when(F.col("method") == "A", F.concat(c, F.lit("-nx"))).otherwise(c))
    return readers.split_methods(tx, name="m").groupBy("method_part").agg(F.count("*").alias("n"))


@query("q_latest_checkpoint", "select path, epoch, step from (select 'epoch=' || (s_suppkey % 7) || '-step=' || (s_suppkey * 10) || '.ckpt' as path, s_suppkey % 7 as epoch, s_suppkey * 10 as step from supplier) order by epoch desc, step desc limit 1")
def _(t):
    return readers.latest_checkpoint(t.table("supplier").select(F.concat(F.lit("epoch="), F.col("s_suppkey") % 7, F.lit("-step="), F.col("s_suppkey") * 10, F.lit(".ckpt")).alias("path")))


# -- filters -----------------------------------------------------------------------------------


@query("q_filter_prefix_qv", "select gene, count(*) as n from v_transcripts where qv >= 20 and not (starts_with(gene, 'NegControlProbe_') or starts_with(gene, 'BLANK_')) group by gene")
def _(t):
    return filters.by_quality(t.tx, PREFIXES).groupBy("gene").agg(F.count("*").alias("n"))


@query("q_filter_qv", "select count(*) as n from v_transcripts where qv >= 28")
def _(t):
    return filters.by_quality(t.tx, (), 28).agg(F.count("*").alias("n"))


@query("q_tile_transcripts", "select transcript_id from v_transcripts where x between 190 and 310 and y between 190 and 310")
def _(t):
    return filters.in_tile(t.tx, (200, 200, 300, 300), 10).select("transcript_id")


_TILED = """select i * 100 as x0, j * 100 as y0, i * 100 + 100 as x3, j * 100 + 100 as y3, i * 1000 + j as tile_id, b.cell_id, b.x, b.y
from v_boundaries b join (select cast(a.range as bigint) as i, cast(b.range as bigint) as j from range(-1, 11) a cross join range(-1, 11) b) g
  on b.x between i * 100 - 20 and i * 100 + 120 and b.y between j * 100 - 20 and j * 100 + 120"""


@query(
    "q_boundary_ownership",
    f"""with v as ({_TILED}), n as (select tile_id, cell_id, count(*) as total,
  sum(case when x between x0 + 20 and x3 - 20 and y between y0 + 20 and y3 - 20 then 1 else 0 end) as c,
  sum(case when y between y0 - 20 and y0 + 20 then 1 else 0 end) as t, sum(case when x between x0 - 20 and x0 + 20 then 1 else 0 end) as l,
  sum(case when x between x3 - 20 and x3 + 20 then 1 else 0 end) as r, sum(case when y between y3 - 20 and y3 + 20 then 1 else 0 end) as b from v group by 1, 2)
select tile_id, cell_id from n where c = total or (c > 0 and l > 0 and b = 0) or (c > 0 and t > 0 and r = 0)""",
)
def _(t):
    b = tiling.sliding(t.bd, -100, -100, 100, 100, 20.0)
    # windows are half-open at the far side; the tile's closed box also holds its far edge
    i, j = (F.explode(F.array(F.col(c) - 1, F.col(c))) for c in ("i", "j"))
    b = b.withColumn("i", i).withColumn("j", j).select(((F.col("i") - 1) * 1000 + F.col("j") - 1).alias("tile_id"), (F.col("i") * 100 - 100).alias("x0"), (F.col("j") * 100 - 100).alias("y0"), "i", "j", "cell_id", "vertex_idx", "x", "y").where("i between 0 and 11 and j between 0 and 11").dropDuplicates(["tile_id", "cell_id", "vertex_idx"])
    return filters.owned_outlines(b.withColumn("x3", F.col("x0") + 100).withColumn("y3", F.col("y0") + 100), 20)


@query("q_gene_in_embedding", "select count(*) as n from v_transcripts where gene in (select p_brand from part where p_size > 45)")
def _(t):
    genes = t.table("part").where("p_size > 45").select(F.col("p_brand").alias("gene")).distinct()
    return t.tx.join(genes, "gene", "left_semi").agg(F.count("*").alias("n"))


_T100 = "cast(floor(x / 100) as bigint) * 1000 + cast(floor(y / 100) as bigint)"


@query("q_tile_viability", f"select p.tile_id, n_points, n_outlines from (select {_T100} as tile_id, count(*) as n_points from v_transcripts group by 1) p join (select {_T100} as tile_id, count(distinct cell_id) as n_outlines from v_boundaries group by 1) o on p.tile_id = o.tile_id where n_points >= 20 and n_outlines >= 2")
def _(t):
    tile = (F.floor(F.col("x") / 100) * 1000 + F.floor(F.col("y") / 100)).alias("tile_id")
    return filters.viable_tiles(t.tx.select(tile), t.bd.select(tile, "cell_id"), 20, 2)


@query("q_cell_viability", "select cell_id, count(*) as n from v_transcripts where cell_id is not null group by cell_id having count(*) >= 5")
def _(t):
    return filters.viable_cells(t.tx, 5)


# -- ids -----------------------------------------------------------------------------------------


@query("q_coord_id", "select transcript_id, cast('0x' || substr(md5(cast(cast(round(x * 1000) as bigint) as varchar) || '_' || cast(cast(round(y * 1000) as bigint) as varchar) || '1996'), 1, 8) as bigint) % 100000000 as coord_id from v_transcripts")
def _(t):
    return t.tx.select("transcript_id", ids.coordinate_id(F.col("x"), F.col("y")).alias("coord_id"))


@query("q_tokens", "select gene, row_number() over (order by gene) - 1 as token from (select distinct gene from v_transcripts)")
def _(t):
    return ids.tokens(t.tx)


@query("q_embedding_lookup", "select gene, count(*) as n, round(sum(w), 4) as w from v_transcripts join (select p_brand, avg(p_retailprice) as w from part group by p_brand) on gene = p_brand group by gene")
def _(t):
    w = t.table("part").groupBy(F.col("p_brand").alias("gene")).agg(F.avg("p_retailprice").alias("w"))
    return ids.embed(t.tx, w).groupBy("gene").agg(F.count("*").alias("n"), R(F.sum("w"), 4).alias("w"))


@query("q_fragment_ids", "select s_suppkey as component, translate(substr(md5(cast(s_suppkey as varchar)), 1, 8), '0123456789abcdef', 'abcdefghijklmnop') || '-nx' as fragment from supplier")
def _(t):
    return t.table("supplier").select(F.col("s_suppkey").alias("component"), ids.fragment_id(F.col("s_suppkey")).alias("fragment"))


@query("q_hex_id", "select o_orderkey, translate(lpad(lower(to_hex(o_orderkey)), 8, '0'), '0123456789abcdef', 'abcdefghijklmnop') || '-1' as letters, cast(o_orderkey as bigint) as back from orders")
def _(t):
    letters = ids.int_to_hex_letters(F.col("o_orderkey"))
    return t.table("orders").select("o_orderkey", letters.alias("letters")).withColumn("back", ids.hex_letters_to_int(F.col("letters")))


@query("q_cluster_codes", "select o_orderkey, case when o_orderpriority = '5-LOW' then 0 else dense_rank() over (order by case when o_orderpriority = '5-LOW' then null else o_orderpriority end nulls last) end as code from orders")
def _(t):
    o = t.table("orders").select("o_orderkey", F.expr("nullif(o_orderpriority, '5-LOW')").alias("p"))
    return ids.cluster_codes(o, "p").select("o_orderkey", "code")


# -- tiles ----------------------------------------------------------------------------------------

_BOX = "(select min(x) as xmin, min(y) as ymin, max(x) as xmax, max(y) as ymax from v_transcripts)"


@query(
    "q_rect_tiles",
    f"""with p as (select t.*, b.*, least(cast(floor((x - xmin) / 150) as bigint), greatest(cast(ceil((xmax - xmin) / 150) as bigint) - 1, 0)) as i,
  least(cast(floor((y - ymin) / 120) as bigint), greatest(cast(ceil((ymax - ymin) / 120) as bigint) - 1, 0)) as j from v_transcripts t cross join {_BOX} b)
select 'x=' || cast(trunc(xmin + i * 150) as bigint) || '_y=' || cast(trunc(ymin + j * 120) as bigint) || '_w=' || cast(trunc(least(150, xmax - (xmin + i * 150))) as bigint) || '_h=' || cast(trunc(least(120, ymax - (ymin + j * 120))) as bigint) as tile_id, count(*) as n from p group by 1""",
)
def _(t):
    return tiling.rectangular(t.tx, readers.extents(t.tx), 150, 120).groupBy("tile_id").agg(F.count("*").alias("n"))


@query("q_sliding_tiles", "select i, j, count(*) as n from v_transcripts join (select cast(a.range as bigint) as i, cast(b.range as bigint) as j from range(0, (select cast(max(x) / 100 as bigint) + 4 from v_transcripts)) a cross join range(0, (select cast(max(y) / 100 as bigint) + 4 from v_transcripts)) b) on x >= i * 100 - 15 and x < i * 100 + 165 and y >= j * 100 - 15 and y < j * 100 + 165 group by i, j")
def _(t):
    return tiling.sliding(t.tx, 0, 0, 100, 150, 15).groupBy("i", "j").agg(F.count("*").alias("n"))


@query(
    "q_ndtree",
    """with s0 as (select *, 0 as a from v_boundaries), q0 as (select case when max(x) - min(x) >= max(y) - min(y) then quantile_cont(x, 0.5) end as qx, quantile_cont(y, 0.5) as qy from s0),
s1 as (select s0.*, case when qx is not null then (case when x <= qx then 0 else 1 end) else (case when y <= qy then 0 else 1 end) end as b from s0, q0),
q1 as (select b, case when max(x) - min(x) >= max(y) - min(y) then quantile_cont(x, 0.5) end as qx, quantile_cont(y, 0.5) as qy from s1 group by b),
s2 as (select s1.*, case when qx is not null then (case when x <= qx then 0 else 1 end) else (case when y <= qy then 0 else 1 end) end as c from s1 join q1 using (b))
select count(*) as n, round(min(x), 6) as xmin, round(max(x), 6) as xmax, round(min(y), 6) as ymin, round(max(y), 6) as ymax from s2 group by b, c""",
)
def _(t):
    r = tiling.tag(t.bd, tiling.regions(t.bd, 4))
    return r.groupBy("tile").agg(F.count("*").alias("n"), R(F.min("x")).alias("xmin"), R(F.max("x")).alias("xmax"), R(F.min("y")).alias("ymin"), R(F.max("y")).alias("ymax")).drop("tile")


@query("q_balanced_tiles")
def _(t):
    n = max(100, t.bd.count() // 6)
    return tiling.tag(t.bd, tiling.balanced(t.bd, n)).groupBy("tile").agg(F.count("*").alias("n"))


_SHARE = "cast('0x' || substr(md5(cast(tile_id as varchar)), 1, 8) as bigint) % 1000"


@query("q_tile_split", f"select tile_id, case when not has_edges then 'test' when {_SHARE} < 700 then 'train' when {_SHARE} < 900 then 'val' else 'test' end as split from (select {_T100} as tile_id, max(nuclear) = 1 as has_edges from v_transcripts group by 1)")
def _(t):
    tiles = t.tx.groupBy((F.floor(F.col("x") / 100) * 1000 + F.floor(F.col("y") / 100)).alias("tile_id")).agg((F.max("nuclear") == 1).alias("has_edges"))
    return tiling.assign_split(tiles).select("tile_id", "split")


@query("q_tile_sample", f"select tile_id from (select distinct {_T100} as tile_id from v_transcripts) order by md5(cast(tile_id as varchar)), tile_id limit (select cast(floor(count(distinct {_T100}) * 0.3) as bigint) from v_transcripts)")
def _(t):
    return tiling.sample_tiles(t.tx.select((F.floor(F.col("x") / 100) * 1000 + F.floor(F.col("y") / 100)).alias("tile_id")).distinct(), 0.3)


# -- geometry ----------------------------------------------------------------------------------------

_EDGES = "(select cell_id, vertex_idx, x as x1, y as y1, coalesce(lead(x) over w, first_value(x) over w) as x2, coalesce(lead(y) over w, first_value(y) over w) as y2 from v_boundaries window w as (partition by cell_id order by vertex_idx))"


@query("q_ring_area_centroid", f"select cell_id, round(abs(sum(x1 * y2 - x2 * y1)) / 2, 4) as area, round(sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)), 4) as cx, round(sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)), 4) as cy from {_EDGES} group by cell_id")
def _(t):
    r = geometry.rings(t.bd).withColumn("c", geometry.centroid(F.col("ring")))
    return r.select("cell_id", R(geometry.area(F.col("ring")), 4).alias("area"), R("c.x", 4).alias("cx"), R("c.y", 4).alias("cy"))


@query("q_ring_scale", "select cell_id, round(max(x) - min(x), 4) as w, round(max(y) - min(y), 4) as h, round(min(x), 4) as x0 from (select cell_id, cx + (x - cx) * 1.5 as x, cy + (y - cy) * 1.5 as y from v_boundaries join (select cell_id, (max(x) + min(x)) / 2 as cx, (max(y) + min(y)) / 2 as cy from v_boundaries group by cell_id) using (cell_id)) group by cell_id")
def _(t):
    s = geometry.rings(t.bd).withColumn("s", geometry.scale(F.col("ring"), 1.5))
    span = lambda c: (F.array_max(f"s.{c}") - F.array_min(f"s.{c}"))
    return s.select("cell_id", R(span("x"), 4).alias("w"), R(span("y"), 4).alias("h"), R(F.array_min("s.x"), 4).alias("x0"))


@query("q_hull", f"select cast(cell_id as varchar) as cell_id, round(abs(sum(x1 * y2 - x2 * y1)) / 2, 4) as hull_area, round(sum(sqrt(power(x2 - x1, 2) + power(y2 - y1, 2))), 4) as hull_perimeter from {_EDGES} group by cell_id")
def _(t):
    return shapes.descriptors(t.bd).select("cell_id", R("hull_area", 4).alias("hull_area"), R("hull_perimeter", 4).alias("hull_perimeter"))


@query("q_descriptors", f"with e as (select cell_id, abs(sum(x1 * y2 - x2 * y1)) / 2 as area, max(x1) - min(x1) as w from {_EDGES} group by cell_id) select cast(cell_id as varchar) as cell_id, round(area, 4) as area, 1.0 as convexity, round(area / ((w / 2) * (w / 2)), 4) as circularity from e")
def _(t):
    return shapes.descriptors(t.bd).select("cell_id", R("area", 4).alias("area"), R("convexity", 4).alias("convexity"), R("circularity", 4).alias("circularity"))


# rings with every other corner drawn in: their hull is the ring of the others
_STAR = "(select b.cell_id, vertex_idx, case when vertex_idx % 2 = 1 then mx + (x - mx) * 0.6 else x end as x, case when vertex_idx % 2 = 1 then my + (y - my) * 0.6 else y end as y from v_boundaries b join (select cell_id, avg(x) as mx, avg(y) as my from v_boundaries group by cell_id) m on m.cell_id = b.cell_id)"
_SHOELACE = lambda src: f"select cell_id, abs(sum(x * ny - nx * y)) / 2 as area, sum(sqrt(power(nx - x, 2) + power(ny - y, 2))) as around from (select cell_id, x, y, coalesce(lead(x) over w, first_value(x) over w) as nx, coalesce(lead(y) over w, first_value(y) over w) as ny from {src} window w as (partition by cell_id order by vertex_idx)) group by cell_id"


@query("q_hull_concave", f"with s as (select * from {_STAR}), r as ({_SHOELACE('s')}), h as ({_SHOELACE('(select * from s where vertex_idx % 2 = 0)')}) select cast(r.cell_id as varchar) as cell_id, round(r.area, 4) as area, round(h.area, 4) as hull_area, round(h.around, 4) as hull_perimeter, round(h.area / r.area, 4) as convexity from r join h on h.cell_id = r.cell_id")
def _(t):
    m = t.bd.groupBy("cell_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    drawn = lambda c, m: F.when(F.col("vertex_idx") % 2 == 1, F.col(m) + (F.col(c) - F.col(m)) * 0.6).otherwise(F.col(c)).alias(c)
    star = t.bd.join(m, "cell_id").select("cell_id", "vertex_idx", drawn("x", "mx"), drawn("y", "my"))
    return shapes.descriptors(star).select("cell_id", *(R(c, 4).alias(c) for c in ("area", "hull_area", "hull_perimeter", "convexity")))


@query("q_point_hulls", f"with s as (select * from {_STAR}) select cell_id, round(area, 4) as hull_area from ({_SHOELACE('(select * from s where vertex_idx % 2 = 0)')})")
def _(t):
    m = t.bd.groupBy("cell_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    drawn = lambda c, m: F.when(F.col("vertex_idx") % 2 == 1, F.col(m) + (F.col(c) - F.col(m)) * 0.6).otherwise(F.col(c)).alias(c)
    return shapes.point_hulls(t.bd.join(m, "cell_id").select("cell_id", drawn("x", "mx"), drawn("y", "my"))).select("cell_id", R("hull_area", 4).alias("hull_area"))


@query("q_elongation")
def _(t):
    return shapes.descriptors(t.bd).select("cell_id", R("elongation", 4).alias("elongation"), R("elongation_perimeter", 4).alias("elongation_perimeter"))


_PIP = f"""(select t.transcript_id as id, e.cell_id from v_transcripts t join (select cell_id, min(x1) as xmin, max(x1) as xmax, min(y1) as ymin, max(y1) as ymax from {_EDGES} group by cell_id) b
  on t.x between xmin and xmax and t.y between ymin and ymax join {_EDGES} e on e.cell_id = b.cell_id
  group by 1, 2, t.x, t.y having sum(case when (y1 > t.y) <> (y2 > t.y) and t.x < (x2 - x1) * (t.y - y1) / (y2 - y1) + x1 then 1 else 0 end) % 2 = 1)"""


@query("q_pip_counts", f"select cell_id, count(*) as n, sum(nuclear)::bigint as n_nuclear from {_PIP} p join (select transcript_id as id, nuclear from v_transcripts) using (id) group by cell_id")
def _(t):
    hit = spatial_join.points_in_rings(t.tx.withColumnRenamed("transcript_id", "id"), t.bd, ("nuclear",))
    return hit.groupBy("cell_id").agg(F.count("*").alias("n"), F.sum("nuclear").alias("n_nuclear"))


@query("q_pip_first_match", f"select t.transcript_id as id, p.c as cell_id, p.c is not null as overlaps from v_transcripts t left join (select id, min(cell_id) as c from {_PIP} group by id) p on p.id = t.transcript_id")
def _(t):
    return spatial_join.first_ring(t.points, t.bd)


@query("q_ring_pad", "select cell_id, cast(13 as bigint) as n, round(max(case when vertex_idx = 0 then x end) * 5 + sum(case when vertex_idx > 0 then x else 0 end) + max(case when vertex_idx = 0 then x end), 4) as sx from v_boundaries group by cell_id")
def _(t):
    p = geometry.rings(t.bd).withColumn("p", geometry.pad(F.col("ring"), 13))
    return p.select("cell_id", F.size("p").cast("long").alias("n"), R(F.aggregate("p.x", F.lit(0.0), lambda a, b: a + b), 4).alias("sx"))


@query("q_ring_sample", "select cell_id, vertex_idx as i, round(x, 4) as x from v_boundaries where vertex_idx in (0, 2, 4, 7)")
def _(t):
    s = geometry.rings(t.bd).withColumn("ring", F.transform("ring", lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), i.alias("i"))))
    return s.select("cell_id", F.explode(geometry.sample(F.col("ring"), 4)).alias("p")).select("cell_id", "p.i", R("p.x", 4).alias("x"))


@query("q_vector_angle", "select transcript_id, round(degrees(acos(greatest(-1.0, least(1.0, (x * y + y * z) / (sqrt(x * x + y * y) * sqrt(y * y + z * z)))))), 4) as angle from v_transcripts where z > 0")
def _(t):
    return t.tx.where("z > 0").select("transcript_id", R(geometry.angle(F.col("x"), F.col("y"), F.col("y"), F.col("z")), 4).alias("angle"))


@query("q_fov_transform", "select transcript_id, round(x + z / 0.00012028, 3) as gx, round((4256 - y) + z / 0.00012028, 3) as gy from v_transcripts")
def _(t):
    gx, gy = geometry.fov_to_global(F.col("x"), F.col("y"), F.col("z"), F.col("z"))
    return t.tx.select("transcript_id", R(gx, 3).alias("gx"), R(gy, 3).alias("gy"))


@query("q_z_level", "select cell_id, cast(floor(avg(z) / 3) * 3 as bigint) as z_level from v_transcripts where cell_id is not null group by cell_id")
def _(t):
    return t.tx.where("cell_id is not null").groupBy("cell_id").agg(geometry.z_level(F.avg("z")).alias("z_level"))


@query("q_boundary_delaunay")
def _(t):
    return shapes.cell_outlines(t.tx).select("cell_id", "length", F.size("ring").alias("vertices"), R("area", 4).alias("area"))


# -- joins --------------------------------------------------------------------------------------------

_NEAR = "select a.transcript_id as src, b.transcript_id as dst, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) as d from v_transcripts a join v_transcripts b on b.x > a.x - {r} and b.x < a.x + {r} and b.y > a.y - {r} and b.y < a.y + {r} and cast(floor(a.x / 20) as int) - cast(floor(b.x / 20) as int) between -1 and 1"


@query("q_knn_tx_tx", f"select src, dst, round(d, 6) as d from (select *, row_number() over (partition by src order by d, dst) as r from ({_NEAR.format(r=2)}) where d < 2 and src <> dst) where r <= 3")
def _(t):
    return spatial_join.self_knn(t.points, 3, 2, include_self=False).select("src", "dst", vectors.rounded(F.col("d"), 6).alias("d"))


@query("q_knn_tx_tx_3d", f"select src, dst, round(d, 6) as d from (select *, row_number() over (partition by src order by d, dst) as r from ({_NEAR.format(r=2).replace('sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))', 'sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2))')}) where d < 2) where r <= 3")
def _(t):
    return spatial_join.self_knn(t.points, 3, 2, ("x", "y", "z")).select("src", "dst", vectors.rounded(F.col("d"), 6).alias("d"))


_CENTRES = "(select cell_id, (max(x) + min(x)) / 2 as x, (max(y) + min(y)) / 2 as y from v_boundaries group by cell_id)"
_TX_BD = f"(select * from (select *, row_number() over (partition by src order by d, dst) as r from (select transcript_id as src, c.cell_id as dst, round(sqrt(power(t.x - c.x, 2) + power(t.y - c.y, 2)), 6) as d from v_transcripts t join {_CENTRES} c on c.x between t.x - 15 and t.x + 15 and c.y between t.y - 15 and t.y + 15) where d < 15) where r <= 3)"


def _tx_bd(t):
    c = t.centres.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
    near = spatial_join.pairs_within(t.points, c, 15.001).withColumn("d", F.round("d", 6)).where("d < 15")
    from pyspark.sql import Window

    return near.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("d", "dst"))).where("r <= 3")


@query("q_knn_tx_bd", f"select src, dst, d from {_TX_BD}")
def _(t):
    return _tx_bd(t).select("src", "dst", "d")


@query("q_nn_max", f"select round(max(m), 6) as d_max from (select a.cell_id, min(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))) as m from {_CENTRES} a join {_CENTRES} b on a.cell_id <> b.cell_id group by a.cell_id)")
def _(t):
    return spatial_join.nearest(t.centres, 15).agg(R(F.max("d")).alias("d_max"))


_RADIUS = f"(select a.cell_id as src, b.cell_id as dst from {_CENTRES} a join {_CENTRES} b on a.cell_id <> b.cell_id and round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), 6) <= 75.5)"


def _radius(t):
    c = t.centres.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
    return spatial_join.radius_graph(c, 75.5)


@query("q_radius_graph", f"select src, dst from {_RADIUS}")
def _(t):
    return _radius(t).select("src", "dst")


@query("q_outer_merge", "select coalesce(cast(o_orderkey as varchar), a.transcript_id) as transcript_id, o_orderpriority, a.k from (select * from orders where o_orderstatus = 'F') full outer join (select transcript_id, count(*) as k from v_assignments where bound = 1 group by 1) a on a.transcript_id = cast(o_orderkey as varchar)")
def _(t):
    o = t.table("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("transcript_id"), "o_orderpriority")
    return graph.merge_points(o, t.assigned.where("bound = 1").groupBy("transcript_id").agg(F.count("*").alias("k")))


@query("q_left_coalesce", "select transcript_id, coalesce(cell_id, nucleus_id) as cell_id from v_transcripts t left join (select s_suppkey from supplier) s on s.s_suppkey = t.nucleus_id")
def _(t):
    s = t.table("supplier").select(F.col("s_suppkey").alias("nucleus_id"), F.col("s_suppkey").alias("new"))
    return graph.fill_from(t.tx, s, "nucleus_id").select("transcript_id", F.col("cell_id").cast("long").alias("cell_id"))


@query("q_common_genes", "select gene from (select distinct gene from v_transcripts where method = 'A' intersect select distinct p_brand from part where p_size < 10)")
def _(t):
    return readers.common_genes(t.tx.where("method = 'A'"), t.table("part").where("p_size < 10").select(F.col("p_brand").alias("gene")))


@query("q_genes_without", "select distinct gene from v_transcripts except select distinct p_brand from part where p_size < 10")
def _(t):
    return readers.genes_without(t.tx, t.table("part").where("p_size < 10").select(F.col("p_brand").alias("gene")))


@query("q_type_pairs", "select a.t as type1, b.t as type2 from (select distinct cell_type as t from v_cells) a join (select distinct cell_type as t from v_cells) b on a.t < b.t")
def _(t):
    return metrics.type_pairs(t.cells)


@query("q_submatrix", f"select src, dst from {_TX_BD} where src in (select transcript_id from v_transcripts where nuclear = 1) and dst in (select s_suppkey from supplier where s_acctbal > 0)")
def _(t):
    rows, cols = t.tx.where("nuclear = 1").select(F.col("transcript_id").alias("id")), t.table("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").cast("long").alias("id"))
    return graph.submatrix(_tx_bd(t).select("src", "dst"), rows, cols)


# -- aggregations ------------------------------------------------------------------------------------


@query("q_group_transform", "select transcript_id, count(*) over (partition by cell_id) as cell_size from v_transcripts where cell_id is not null")
def _(t):
    from pyspark.sql import Window

    return t.tx.where("cell_id is not null").select("transcript_id", F.count("*").over(Window.partitionBy("cell_id")).alias("cell_size"))


@query("q_count_matrix", f"select cell_id, gene, n from (select *, sum(n) over (partition by cell_id) as s from {COUNTS}) where s >= 5")
def _(t):
    return matrix.counts(t.tx, 5)


def _panel(t) -> list[str]:
    """All genes of the cells, in order; a bounded panel."""
    return [r.gene for r in t.counts.select("gene").distinct().orderBy("gene").collect()]


@query("q_count_pivot", f"pivot {COUNTS} on gene using coalesce(sum(n), 0)::bigint group by cell_id")
def _(t):
    return matrix.pivoted(t.counts, _panel(t))


@query("q_cell_summary", "select cell_id, round(avg(x), 9) as cell_centroid_x, round(avg(y), 9) as cell_centroid_y, count(*) as transcripts, count(distinct gene) as unique_transcripts from v_transcripts where cell_id is not null group by cell_id")
def _(t):
    return matrix.cell_summary(t.tx).withColumn("cell_centroid_x", R("cell_centroid_x", 9)).withColumn("cell_centroid_y", R("cell_centroid_y", 9))


@query("q_obs", "select c.cell_id, cell_type, n from v_cells c join (select cell_id, count(*) as n from v_transcripts where cell_id is not null group by 1) s on s.cell_id = c.cell_id")
def _(t):
    return t.cells.join(matrix.cell_summary(t.tx).select("cell_id", F.col("transcripts").alias("n")), "cell_id").select("cell_id", "cell_type", "n")


@query("q_gene_assign_counts", "select gene, count(cell_id) as total_assigned, count(*) - count(cell_id) as total_unassigned from v_transcripts group by gene")
def _(t):
    return matrix.gene_counts(t.tx)


@query("q_panel_completion", "select p.gene, coalesce(a, 0) as total_assigned, coalesce(u, 0) as total_unassigned from (select distinct p_brand as gene from part) p left join (select gene, count(cell_id) as a, count(*) - count(cell_id) as u from v_transcripts group by gene) using (gene)")
def _(t):
    return matrix.gene_counts(t.tx, t.table("part").select(F.col("p_brand").alias("gene")).distinct())


@query(
    "q_transcript_metrics",
    """with g as (select * from v_transcripts where qv > 30), a as (select count(*) as n, count(cell_id) as s, count(case when cell_id is not null and nuclear = 1 then 1 end) as u,
  count(case when cell_id is not null and nuclear = 0 then 1 end) as c, count(case when nuclear = 0 then 1 end) as o, count(case when nuclear = 0 and cell_id is null then 1 end) as f from g)
select round(s / (n + 1) * 100, 6) as percent_assigned, round(c / (s + 1) * 100, 6) as percent_cytoplasmic, round(u / (s + 1) * 100, 6) as percent_nucleus, round(f / (o + 1) * 100, 6) as percent_non_assigned_cytoplasmic from a""",
)
def _(t):
    m = matrix.transcript_metrics(t.tx)
    return m.select(*(R(c).alias(c) for c in m.columns))


@query(
    "q_gene_metrics",
    """with g as (select * from v_transcripts where qv > 30), e as (select gene, round(count(cell_id) / (count(*) + 1) * 100, 6) as a from g group by gene),
c as (select gene, round(count(*) / ((select count(*) from g where cell_id is not null and nuclear = 0) + 1) * 100, 6) as c from g where cell_id is not null and nuclear = 0 group by gene)
select coalesce(e.gene, c.gene) as gene, coalesce(a, 0.0) as percent_assigned, coalesce(c, 0.0) as percent_cytoplasmic from e full outer join c on e.gene = c.gene""",
)
def _(t):
    return matrix.gene_metrics(t.tx).select("gene", R("percent_assigned").alias("percent_assigned"), R("percent_cytoplasmic").alias("percent_cytoplasmic"))


@query("q_abundance", f"select gene, cell_type, round(count(*) / any_value(k), 6) as abundance from {COUNTS} c join v_cells t on t.cell_id = c.cell_id join (select cell_type as ct, count(*) as k from v_cells group by 1) on ct = cell_type group by gene, cell_type")
def _(t):
    return matrix.abundance(t.counts, t.cells).withColumn("abundance", R("abundance"))


@query("q_normalise_log1p", f"select cell_id, gene, round(ln(1 + n * 10000.0 / sum(n) over (partition by cell_id)), 6) as value from {COUNTS}")
def _(t):
    return vectors.normalise(t.counts).select("cell_id", "gene", R("value").alias("value"))


@query("q_percentiles", "select gene, round(quantile_cont(x, 0.05), 6) as p5, round(quantile_cont(x, 0.95), 6) as p95 from v_transcripts group by gene")
def _(t):
    return matrix.gene_percentiles(t.tx, "x", [0.05, 0.95]).select("gene", R("p5").alias("p5"), R("p95").alias("p95"))


_BIN = lambda c, src: f"select s.*, 1 + " + " + ".join(f"(case when {c} > e{i} then 1 else 0 end)" for i in range(1, 10)) + f" as bin from {src} s cross join (select " + ", ".join(f"quantile_cont({c}, {i / 10}) as e{i}" for i in range(1, 10)) + f" from {src})"


@query("q_qcut", f"select bin, count(*) as n, round(avg(area), 6) as mean, round(var_pop(area), 4) as var from ({_BIN('area', 'v_cells')}) group by bin")
def _(t):
    return metrics.quantile_bins(t.cells, "area").groupBy(F.col("bin").cast("int").alias("bin")).agg(F.count("*").alias("n"), R(F.avg("area")).alias("mean"), R(F.var_pop("area"), 4).alias("var"))


@query("q_percent_assigned", "select method, gene, round(case when max(k) over (partition by gene) > 0 then k / max(k) over (partition by gene) * 100 else 0.0 end, 6) as percent from (select method, gene, count(cell_id) as k from v_transcripts group by 1, 2)")
def _(t):
    return metrics.percent_assigned(t.tx).withColumn("percent", R("percent"))


@query("q_cluster_medians", f"select cell_type, gene, round(quantile_cont(coalesce(n, 0), 0.5), 6) as median from (select t.cell_id, cell_type, g.gene, n from v_cells t cross join (select distinct gene from v_transcripts where cell_id is not null) g left join {COUNTS} c on c.cell_id = t.cell_id and c.gene = g.gene) group by 1, 2")
def _(t):
    return matrix.cluster_medians(t.counts, t.cells, _panel(t)).withColumn("median", R("median"))


@query("q_top_genes", f"select gene, round(sum(n) / 1000.0, 6) as mean_n from {COUNTS} group by gene order by sum(n) desc, gene limit 10")
def _(t):
    return matrix.top_genes(t.counts, 1000, 10).withColumn("mean_n", R("mean_n"))


@query("q_tuning_metrics", "select round(count(cell_id) / count(*), 6) as frac_assigned, (select round(avg(n), 6) from (select count(*) as n from v_transcripts where cell_id is not null group by cell_id)) as mean_cell_size, cast(null as double) as mean_fragment_size from v_transcripts")
def _(t):
    m = matrix.tuning_metrics(t.tx)
    return m.select(*(R(c).alias(c) for c in m.columns))


@query("q_param_heuristics", "with a as (select quantile_cont(2 * sqrt(area / pi()), 0.5) / 4 as d from v_cells), k as (select quantile_cont(n / 20.0, 0.9) as q from (select count(*) as n from v_transcripts where cell_id is not null group by cell_id)) select round(d, 6) as dist_tx, cast(ceil(pi() * d * d * q) as bigint) as k_tx from a, k")
def _(t):
    return matrix.neighbour_parameters(t.cells, t.tx, 20.0).withColumn("dist_tx", R("dist_tx"))


@query("q_runs", "select sum(case when p is null or p <> method then 1 else 0 end)::bigint as runs from (select method, lag(method) over (order by transcript_id) as p from v_transcripts)")
def _(t):
    return metrics.runs(t.tx, "transcript_id", "method", 10**12)


@query("q_unpivot", "select method, kind, v from (select method, count(cell_id) as a, sum(nuclear)::bigint as n from v_transcripts group by method) unpivot (v for kind in (a, n))")
def _(t):
    w = t.tx.groupBy("method").agg(F.count("cell_id").alias("a"), F.sum("nuclear").alias("n"))
    return w.unpivot("method", ["a", "n"], "kind", "v")


@query("q_scalar_functions", "select s_suppkey, lpad(cast(s_suppkey as varchar), 5, '0') as filled, s_name like '%1' as ends, round(log2(s_suppkey + 1), 6) as l2, round(sqrt(s_suppkey), 6) as root, round(1 / (1 + exp(-(s_acctbal / 10000))), 6) as sig, cast(floor(s_suppkey / 3) * 3 as bigint) as fl from supplier")
def _(t):
    s = t.table("supplier")
    return s.select("s_suppkey", F.lpad(F.col("s_suppkey").cast("string"), 5, "0").alias("filled"), F.col("s_name").endswith("1").alias("ends"), R(F.log2(F.col("s_suppkey") + 1)).alias("l2"), R(F.sqrt("s_suppkey")).alias("root"), R(vectors.sigmoid(F.col("s_acctbal") / 10000)).alias("sig"), geometry.z_level(F.col("s_suppkey")).alias("fl"))


# -- graph -------------------------------------------------------------------------------------------


@query("q_assign", "select transcript_id, max(score) as score, case when max(score) >= 0.5 then 1 else 0 end as bound from v_assignments group by 1")
def _(t):
    e = t.assigned.select(F.col("transcript_id").alias("src"), F.col("cell_id").cast("long").alias("dst"), "score")
    return graph.best(e, 0.5).select(F.col("src").alias("transcript_id"), "score", "bound")


@query("q_dedup_best", "select transcript_id, score, cell_id, bound from (select *, row_number() over (partition by transcript_id order by bound desc, score desc nulls last, cell_id) as r from v_assignments) where r = 1")
def _(t):
    return graph.dedup_best(t.assigned)


@query("q_median_score", "select round(quantile_cont(score, 0.5), 6) as median, count(case when bound = 1 then 1 end) as bound from v_assignments")
def _(t):
    return t.assigned.agg(R(F.percentile("score", F.lit(0.5))).alias("median"), F.count(F.when(F.col("bound") == 1, 1)).alias("bound"))


@query("q_belongs_edges", "select transcript_id as src, cell_id as dst from v_transcripts where nuclear = 1 and cell_id in (select cell_id from v_cells where area > 100)")
def _(t):
    return graph.belongs(t.tx, t.cells.where("area > 100"))


_POS = "(select transcript_id as src, nucleus_id as dst from v_transcripts where nuclear = 1)"


@query("q_negative_edges", f"with pos as (select * from {_POS}), neg as (select src, dst, row_number() over (partition by src order by md5(cast(src as varchar) || ':' || cast(dst as varchar)), dst) as r from {_TX_BD} c where src in (select src from pos) and not exists (select 1 from pos where pos.src = c.src and pos.dst = c.dst)) select src, dst, 1 as label from pos union all select src, dst, 0 from neg where r <= 1")
def _(t):
    pos = t.tx.where("nuclear = 1").select(F.col("transcript_id").alias("src"), F.col("nucleus_id").alias("dst"))
    return graph.negatives(_tx_bd(t), pos)


@query("q_padded_adjacency", f"select src, array_to_string(list_resize(list(dst order by dst), 3, -1), ',') as neighbours from {_TX_BD} group by src")
def _(t):
    return graph.padded(_tx_bd(t), 3).withColumn("neighbours", F.array_join("neighbours", ","))


#: Neighbours of a vector in the edge tables over all vectors.
K_VECTORS = 10


def _nearest_sql(k: int) -> str:
    return f"(select src, dst, s from (select *, row_number() over (partition by src order by s desc, dst) as r from (select a.vec_id as src, b.vec_id as dst, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 9) as s from embeddings a join embeddings b on a.vec_id <> b.vec_id)) where r <= {k})"


def _edges(t, k=K_VECTORS):
    """(src, dst, s): every vector and its nearest others."""
    return graph.nearest_vectors(t.vectors, t.vectors, k)


@query("q_similarity", f"select src, dst, round(1 / (1 + exp(-s)), 5) as score from {_nearest_sql(K_VECTORS)}")
def _(t):
    return graph.similarity(_edges(t).select("src", "dst"), t.vectors, t.vectors).select("src", "dst", R("score", 5).alias("score"))


@query("q_similarity_best", f"select src, round(1 / (1 + exp(-s)), 5) as score from {_nearest_sql(1)}")
def _(t):
    return graph.best(_edges(t, 1).select("src", "dst", vectors.link_score(F.col("s")).alias("score")), 0.5).select("src", R("score", 5).alias("score"))


@query("q_softmax", f"select src, dst, round(exp(s) / sum(exp(s)) over (partition by src), 5) as weight from {_nearest_sql(K_VECTORS)}")
def _(t):
    return vectors.softmax(_edges(t), ["src"], "s").select("src", "dst", R("weight", 5).alias("weight"))


_LEFT = "(select a.transcript_id as src, b.transcript_id as dst from v_transcripts a join v_transcripts b on a.cell_id is null and b.cell_id is null and a.gene = b.gene and a.transcript_id <> b.transcript_id and abs(a.x - b.x) < 2 and abs(a.y - b.y) < 2 and sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) < 2)"


def _left(t):
    free = t.tx.where("cell_id is null").select(F.col("transcript_id").alias("id"), "x", "y", "gene")
    e = spatial_join.self_pairs(free, 2).where("src <> dst")
    g = free.select("id", "gene")
    return e.join(g.select(F.col("id").alias("src"), "gene"), "src").join(g.select(F.col("id").alias("dst"), F.col("gene").alias("g2")), "dst").where("gene = g2").select("src", "dst", "d")


_COMMON = "(select a.transcript_id as src, b.transcript_id as dst, round(1 / (1 + sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))), 9) as score from v_transcripts a join v_transcripts b on a.gene = b.gene and a.nuclear = 0 and b.nuclear = 0 and abs(a.x - b.x) < 4 and abs(a.y - b.y) < 4 and sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) < 4)"


@query("q_leftover_edges", f"with e as (select * from {_COMMON}) select src, dst from e where score >= (select quantile_cont(score, 0.5) from e) and score >= 0.25 and src <> dst and src not in (select transcript_id from v_transcripts where qv >= 32) and dst not in (select transcript_id from v_transcripts where qv >= 32)")
def _(t):
    free = t.tx.where("nuclear = 0").select(F.col("transcript_id").alias("id"), "x", "y", "gene")
    taken = t.tx.where("qv >= 32").select(F.col("transcript_id").alias("id"))
    return graph.leftover_pairs(free, taken, 4, lambda d: F.round(1 / (1 + d), 9), 0.25, by=("gene",)).select("src", "dst")


_CC = f"e as (select src, dst from {_LEFT}), r as (select src as node, src as c from e union select r.node, e.dst from r join e on e.src = r.c)"


@query("q_components", f"with recursive {_CC} select node, min(c) as component from r group by node")
def _(t):
    return components.components(_left(t))


@query("q_fill_unassigned", f"with recursive {_CC}, m as (select node, min(c) as k from r group by node) select transcript_id, coalesce(cast(cell_id as varchar), translate(substr(md5(cast(k as varchar)), 1, 8), '0123456789abcdef', 'abcdefghijklmnop') || '-nx') as cell_id from v_transcripts left join m on node = transcript_id")
def _(t):
    return graph.fill_unassigned(t.tx.select("transcript_id", "cell_id"), _left(t))


@query("q_attention_layer")
def _(t):
    v = t.vectors.select("id", F.col("v").alias("h"))
    size = t.vectors.agg(F.max(F.size("v"))).first()[0] or 0
    e = _edges(t).select(F.col("dst").alias("src"), F.col("src").alias("dst"))  # every vector hears from its neighbours
    eye = [[1.0 if i == j else 0.1 for j in range(size)] for i in range(size)]
    out = graph.attention_layer(v, e, eye, eye, [(0.5, -0.25, 0.25, 1.0)[i % 4] for i in range(size)])
    return out.select("id", F.transform("h", lambda x: F.round(x, 6)).alias("h"))


@query("q_segment")
def _(t):
    return segment.segment(t.tx, t.bd, segment.by_distance(10), dist_tx=2).groupBy("bound").agg(F.count("*").alias("n"), F.count("cell_id").alias("assigned"))


# -- learning ----------------------------------------------------------------------------------------


@query("q_auroc_f1", "with s as (select case when l_returnflag = 'R' then 1 else 0 end as label, round(l_discount * 4 + l_tax * 3, 3) as score from lineitem), k as (select score, sum(label) as p, sum(1 - label) as n from s group by score), b as (select *, coalesce(sum(n) over (order by score rows between unbounded preceding and 1 preceding), 0) as below from k) select round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) as auroc, (select round(2.0 * sum(case when score >= 0.3 and label = 1 then 1 else 0 end) / (2 * sum(case when score >= 0.3 and label = 1 then 1 else 0 end) + sum(case when score >= 0.3 and label = 0 then 1 else 0 end) + sum(case when score < 0.3 and label = 1 then 1 else 0 end)), 6) from s) as f1 from b")
def _(t):
    s = t.table("lineitem").select(F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"), F.round(F.col("l_discount") * 4 + F.col("l_tax") * 3, 3).alias("score"))
    e = learn.evaluate(s, 0.3)
    return e.select(R("auroc").alias("auroc"), R("f1").alias("f1"))


@query("q_link_scorer")
def _(t):
    v = t.vectors
    end = lambda c, label: v.select(F.col("id").alias(c), F.col("label").alias(label))
    e = _edges(t).select("src", "dst").join(end("src", "l1"), "src").join(end("dst", "l2"), "dst")
    f = learn.link_features(e.withColumn("label", (F.col("l1") == F.col("l2")).cast("int")), v, v)
    m = learn.fit_link_scorer(f, 10)
    from pyspark.ml.functions import vector_to_array

    s = m.transform(f).select("label", vector_to_array("probability")[1].alias("score"))
    return learn.evaluate(s).select(F.round("auroc", 3).alias("auroc"), F.round("f1", 3).alias("f1"))


@query("q_label_transfer", f"select src as id, max_by(label, k * 1000 - label) as label from (select src, label, count(*) as k from {_nearest_sql(5)} join embeddings on vec_id = dst group by 1, 2) group by src")
def _(t):
    return learn.transfer_labels(_edges(t, 5), t.vectors.select("id", "label"))


# -- validation --------------------------------------------------------------------------------------

_EXPR = f"""x as (select t.cell_type, g.gene, count(distinct t.cell_id) as cells from v_cells t cross join (select distinct gene from v_transcripts where cell_id is not null) g group by 1, 2),
e as (select x.cell_type, x.gene, cells, coalesce(s, 0) / cells as mean, coalesce(k, 0) / cells as share, coalesce(k, 0) as k from x left join (select cell_type, gene, sum(n) as s, count(*) as k from {COUNTS} c join v_cells t on t.cell_id = c.cell_id group by 1, 2) q on q.cell_type = x.cell_type and q.gene = x.gene)"""
_MARK = f"{_EXPR}, u as (select cell_type, quantile_cont(mean, 0.8) as hi, quantile_cont(mean, 0.1) as lo from e group by 1), mk as (select e.cell_type, gene, case when mean >= hi and share * 100 >= 10 then 'positive' when mean <= lo then 'negative' end as marker from e join u on u.cell_type = e.cell_type)"


def _markers(t):
    return metrics.markers(t.counts, t.cells, 20, 10, 10)


@query("q_markers", f"with {_MARK} select * from mk where marker is not null")
def _(t):
    return _markers(t)


@query("q_exclusive_pairs", f"with {_EXPR}, s as (select gene, sum(k) as ak, sum(cells) as ac from e group by gene), z as (select cell_type, e.gene from e join s on s.gene = e.gene where share > 0.128 and (ak - k) / (ac - cells) < 0.135) select distinct least(a.gene, b.gene) as gene1, greatest(a.gene, b.gene) as gene2 from z a join z b on a.cell_type < b.cell_type and a.gene <> b.gene")
def _(t):
    return metrics.exclusive_pairs(metrics.exclusive_genes(t.counts, t.cells, 0.128, 0.135))


_GENES = "(select distinct gene as g from v_transcripts where cell_id is not null)"
_GP = f"(select a.g as gene1, b.g as gene2 from {_GENES} a join {_GENES} b on a.g < b.g)"


def _pairs(t):
    g = _panel(t)
    return t.spark.createDataFrame([(a, b) for a in g for b in g if a < b], "gene1 string, gene2 string")


_MECR = "select {g} gene1, gene2, case when count(distinct case when h1 or h2 then cell_id end) > 0 then count(distinct case when h1 and h2 then cell_id end) / count(distinct case when h1 or h2 then cell_id end) else 0.0 end as mecr from (select {g} gene1, gene2, cell_id, bool_or(gene = gene1) as h1, bool_or(gene = gene2) as h2 from {src} cross join {gp} group by all) group by {g} gene1, gene2"


@query("q_mecr", f"select gene1, gene2, round(mecr, 6) as mecr from ({_MECR.format(g='', src=COUNTS, gp=_GP)})")
def _(t):
    return metrics.mecr(t.counts, _pairs(t)).withColumn("mecr", R("mecr"))


def _mecr_sql(column: str, cells: str) -> str:
    return f"""with b as ({_BIN(column, cells)}), m as ({_MECR.format(g='bin,', src=f'(select b.bin, c.* from {COUNTS} c join b on b.cell_id = c.cell_id)', gp=_GP)})
select s.bin / 10 as quantile, round(a, 6) as average_mecr, round(v, 6) as variance_mecr, round(av, 6) as average, num_cells from (select bin, avg({column}) as av, count(*) as num_cells from b group by bin) s left join (select bin, avg(mecr) as a, var_pop(mecr) as v from m group by bin) q on q.bin = s.bin"""


def _rounded(df):
    return df.select(F.col("quantile").cast("double").alias("quantile"), *(R(c).alias(c) for c in ("average_mecr", "variance_mecr", "average")), "num_cells")


@query("q_mecr_by_area", _mecr_sql("area", "v_cells"))
def _(t):
    return _rounded(metrics.mecr_by_quantile(t.counts, _pairs(t), t.cells, "area"))


@query("q_mecr_by_count", _mecr_sql("k", "(select cell_id, sum(n) as k from " + COUNTS + " group by cell_id)"))
def _(t):
    return _rounded(metrics.mecr_by_quantile(t.counts, _pairs(t), t.counts.groupBy("cell_id").agg(F.sum("n").alias("k")), "k"))


# cells of a line: neighbours are the next two orders
_NB = "(select a.cell_id as src, b.cell_id as dst from v_cells a join v_cells b on b.cell_id <> a.cell_id and b.cell_id between a.cell_id - 2 and a.cell_id + 2)"


def _line(t):
    c = t.cells.select(F.col("cell_id").alias("id"), F.col("cell_id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    return spatial_join.radius_graph(c, 2.0).select("src", "dst")


# D of a cell and marker of its type, over the cell and its neighbours; inner markers per pair of types
_CONT = f"""{_MARK}, p as (select cell_type, gene from mk where marker = 'positive'), nb as (select * from {_NB}), c as (select * from {COUNTS}),
ty as (select cell_id, cell_type from v_cells where cell_type in (select cell_type from p)), tt as (select distinct cell_type as ct from p),
d as (select t.cell_id as src, p.gene, coalesce(o.n, 0) + coalesce(a.n, 0) as d from ty t join p on p.cell_type = t.cell_type left join c o on o.cell_id = t.cell_id and o.gene = p.gene
  left join (select src, gene, sum(n) as n from nb join c on c.cell_id = nb.dst group by 1, 2) a on a.src = t.cell_id and a.gene = p.gene),
df as (select a.cell_type as st, b.ct as tt, a.gene from p a join tt b on a.cell_type <> b.ct and not exists (select 1 from p q where q.cell_type = b.ct and q.gene = a.gene)),
ac as (select nb.src, nb.dst, a.cell_type as st, b.cell_type as tt from nb join ty a on a.cell_id = nb.src join ty b on b.cell_id = nb.dst where a.cell_type <> b.cell_type),
i as (select ac.*, df.gene, coalesce(c.n, 0) as n from ac join df on df.st = ac.st and df.tt = ac.tt left join c on c.cell_id = ac.dst and c.gene = df.gene)"""
_CONT_OUT = "select a.ct as source_type, b.ct as target_type, round(coalesce(s, 0.0) / (coalesce(k, 0) + 1), 6) as contamination from tt a cross join tt b left join r on r.st = a.ct and r.tt = b.ct"


@query("q_contamination", f"with {_CONT}, r as (select i.st, i.tt, sum(i.n / o.d) as s, count(*) as k from i join d o on o.src = i.src and o.d > 0 group by 1, 2) {_CONT_OUT}")
def _(t):
    return metrics.contamination(t.counts, t.cells, _markers(t), _line(t)).withColumn("contamination", R("contamination"))


@query("q_contamination_clean", f"with {_CONT}, r as (select i.st, i.tt, sum(i.n / o.d) as s, count(*) as k from i join d o on o.src = i.src and o.gene = i.gene and o.d > 0 group by 1, 2) {_CONT_OUT}")
def _(t):
    return metrics.contamination(t.counts, t.cells, _markers(t), _line(t), clean=True).withColumn("contamination", R("contamination"))


@query("q_sensitivity", f"with {_MARK}, p as (select cell_type, gene from mk where marker = 'positive'), s as (select cell_type, count(*) as m from p group by 1), sm as (select * from (select cell_id, cell_type, row_number() over (partition by cell_type order by md5(cast(cell_id as varchar)), cell_id) as r from v_cells) where r <= 1000), h as (select sm.cell_id, count(*) as k from sm join {COUNTS} c on c.cell_id = sm.cell_id join p on p.cell_type = sm.cell_type and p.gene = c.gene group by 1) select sm.cell_id, sm.cell_type, round(coalesce(k, 0) / m, 6) as sensitivity from sm join s on s.cell_type = sm.cell_type left join h on h.cell_id = sm.cell_id")
def _(t):
    return metrics.sensitivity(t.counts, t.cells, _markers(t), 1000).withColumn("sensitivity", R("sensitivity"))


_PTS = "(select x, y, z, method from v_transcripts)"


@query("q_calinski", f"with p as (select * from {_PTS}), m as (select method, count(*) as n, avg(x) as mx, avg(y) as my, avg(z) as mz, var_pop(x) + var_pop(y) + var_pop(z) as v from p group by method), g as (select count(*) as nn, avg(x) as gx, avg(y) as gy, avg(z) as gz from p) select round((sum(n * (power(mx - gx, 2) + power(my - gy, 2) + power(mz - gz, 2))) / (count(*) - 1)) / (sum(n * v) / (max(nn) - count(*))), 4) as calinski_harabasz from m, g")
def _(t):
    return metrics.calinski_harabasz(t.tx, ["x", "y", "z"], "method").select(R("calinski_harabasz", 4).alias("calinski_harabasz"))


@query("q_silhouette", f"with p as (select row_number() over () as i, * from {_PTS}), g as (select method as g, count(*) as n, sum(x) as sx, sum(y) as sy, sum(z) as sz, sum(x * x + y * y + z * z) as q from p group by method), d as (select i, method, g, n, (x * x + y * y + z * z) * n + q - 2 * (x * sx + y * sy + z * sz) as t from p, g), s as (select i, max(case when method = g and n > 1 then t / (n - 1) end) as a, min(case when method <> g then t / n end) as b from d group by i) select round(avg(case when a is null then 0.0 else (b - a) / greatest(a, b) end), 5) as silhouette from s")
def _(t):
    return metrics.silhouette(t.tx, ["x", "y", "z"], "method").select(R("silhouette", 5).alias("silhouette"))


@query("q_entropy", f"select src as cell_id, sum(k)::bigint as neighbours, round(-sum(k / s * ln(k / s)), 6) + 0.0 as entropy from (select *, sum(k) over (partition by src) as s from (select src, cell_type, count(*) as k from {_NB} join v_cells on cell_id = dst group by 1, 2)) group by src")
def _(t):
    return metrics.neighbourhood_entropy(_line(t), t.cells).withColumn("entropy", R("entropy") + F.lit(0.0))


@query("q_density", f"select c.cell_id, round(s / area, 6) as density, round(log2(s / area + 1), 6) as log_density from v_cells c join (select cell_id, sum(n) as s from {COUNTS} group by 1) q on q.cell_id = c.cell_id")
def _(t):
    d = metrics.density(t.counts, t.cells)
    return d.select("cell_id", R("density").alias("density"), R("log_density").alias("log_density"))


@query("q_method_compare", "select a.gene, a.v as v_1, b.v as v_2 from (select gene, round(avg(qv), 6) as v from v_transcripts where method = 'A' group by gene) a join (select gene, round(avg(qv), 6) as v from v_transcripts where method = 'R' group by gene) b on a.gene = b.gene")
def _(t):
    m = lambda k: t.tx.where(F.col("method") == k).groupBy("gene").agg(R(F.avg("qv")).alias("v"))
    return metrics.compare_methods(m("A"), m("R"), "gene", "v")


@query("q_method_summary", "select method, count(*) as cells, round(quantile_cont(counts, 0.5), 6) as median_counts from (select method, cell_id, count(*) + 1 as counts from v_transcripts where cell_id is not null group by 1, 2) group by method")
def _(t):
    return metrics.method_summary(t.tx).withColumn("median_counts", R("median_counts"))


@query("q_gene_counts_normalised", "select method, gene, round(case when max(k) over (partition by gene) > 0 then k / max(k) over (partition by gene) end, 6) as share from (select method, gene, count(cell_id) as k from v_transcripts group by 1, 2)")
def _(t):
    return metrics.normalised_gene_counts(t.tx).withColumn("share", R("share"))


@query("q_method_areas", f"select c.cell_id, round(area + 1, 6) as area_plus_one, round(log2(s / area + 1), 6) as log_density from v_cells c join (select cell_id, sum(n) as s from {COUNTS} group by 1) q on q.cell_id = c.cell_id")
def _(t):
    m = metrics.method_areas(t.cells, t.counts)
    return m.select("cell_id", R("area_plus_one").alias("area_plus_one"), R("log_density").alias("log_density"))


@query("q_method_correlation", "select round(corr(a.v, b.v), 6) as r from (select gene, avg(x) as v from v_transcripts where method = 'A' group by gene) a join (select gene, avg(x) as v from v_transcripts where method = 'R' group by gene) b on a.gene = b.gene")
def _(t):
    m = lambda k: t.tx.where(F.col("method") == k).groupBy("gene").agg(F.avg("x").alias("v"))
    return metrics.compare_methods(m("A"), m("R"), "gene", "v").agg(R(F.corr("v_1", "v_2")).alias("r"))


@query("q_csr", f"select gene, (sum(k) over (order by gene) - k)::bigint as indptr_begin, (sum(k) over (order by gene))::bigint as indptr_end, array_to_string(indices, ',') as indices from (select gene, count(*) as k, list(cell_id order by cell_id) as indices from {COUNTS} group by gene)")
def _(t):
    return matrix.csr(t.counts, "gene", "cell_id").withColumn("indices", F.array_join("indices", ","))


@query("q_purity_f1", "with t as (select cell_type, case when segment in ('BUILDING', 'MACHINERY') then cell_type else '1-URGENT' end as predicted from v_cells) select a.cell_type, round(2.0 * coalesce(tp, 0) / (n + coalesce(p, 0)), 6) as f1 from (select cell_type, count(*) as n, sum(case when cell_type = predicted then 1 else 0 end) as tp from t group by 1) a left join (select predicted, count(*) as p from t group by 1) b on b.predicted = a.cell_type")
def _(t):
    c = t.cells.withColumn("predicted", F.when(F.col("segment").isin("BUILDING", "MACHINERY"), F.col("cell_type")).otherwise("1-URGENT"))
    return metrics.purity_f1(c).withColumn("f1", R("f1"))


@query("q_average_expression", f"select cell_type, gene, round(avg(n), 6) as mean_n from {COUNTS} c join v_cells t on t.cell_id = c.cell_id group by 1, 2")
def _(t):
    return metrics.average_expression(t.counts, t.cells).withColumn("mean_n", R("mean_n"))


@query("q_explorer_cells", "select cell_id, count(*) as n, round(avg(x), 9) as cx, round(avg(y), 9) as cy, cast(floor(avg(z) / 3) * 3 as bigint) as z_level from v_transcripts where cell_id is not null group by cell_id having count(*) >= 5")
def _(t):
    return sinks.explorer_cells(t.tx, t.bd).select("cell_id", "n", R("cx", 9).alias("cx"), R("cy", 9).alias("cy"), "z_level")


# -- dataset -----------------------------------------------------------------------------------------

_DATASET = """with bx as (select least((select min(x) from v_transcripts), (select min(x) from v_boundaries)) as xmin, least((select min(y) from v_transcripts), (select min(y) from v_boundaries)) as ymin,
  greatest((select max(x) from v_transcripts), (select max(x) from v_boundaries)) as xmax, greatest((select max(y) from v_transcripts), (select max(y) from v_boundaries)) as ymax),
ti as (select xmin + i * 150 as x0, ymin + j * 120 as y0, least(xmin + i * 150 + 150, xmax) as x3, least(ymin + j * 120 + 120, ymax) as y3
  from bx, (select unnest(range(0, (select cast(ceil((xmax - xmin) / 150) as bigint) from bx))) as i) a, (select unnest(range(0, (select cast(ceil((ymax - ymin) / 120) as bigint) from bx))) as j) b),
tl as (select *, 'x=' || cast(trunc(x0) as bigint) || '_y=' || cast(trunc(y0) as bigint) || '_w=' || cast(trunc(x3 - x0) as bigint) || '_h=' || cast(trunc(y3 - y0) as bigint) as tile_id from ti),
tx as (select tile_id, transcript_id as id, x, y, z, nuclear, nucleus_id as cell_id from v_transcripts join tl on x between x0 - 10 and x3 + 10 and y between y0 - 10 and y3 + 10),
vt as (select tl.*, b.cell_id, b.x, b.y from v_boundaries b join tl on b.x between x0 - 10 and x3 + 10 and b.y between y0 - 10 and y3 + 10),
n as (select tile_id, cell_id, count(*) as total, sum(case when x between x0 + 10 and x3 - 10 and y between y0 + 10 and y3 - 10 then 1 else 0 end) as c,
  sum(case when y <= y0 + 10 then 1 else 0 end) as t, sum(case when x <= x0 + 10 then 1 else 0 end) as l, sum(case when x >= x3 - 10 then 1 else 0 end) as r, sum(case when y >= y3 - 10 then 1 else 0 end) as b from vt group by 1, 2),
ow as (select tile_id, cell_id from n where (c = total or (c > 0 and l > 0 and b = 0) or (c > 0 and t > 0 and r = 0)) and tile_id in (select tile_id from tx)),
ar as (select cell_id, abs(sum(x1 * y2 - x2 * y1)) / 2 as area, sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) as cx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) as cy from {edges} group by cell_id),
bd as (select ow.tile_id, ar.*, sqrt(max(area) over (partition by ow.tile_id)) * 10 as reach from ow join ar on ar.cell_id = ow.cell_id),
tt as (select tile_id, sum(least(k, 3)) as n_tx_tx from (select a.tile_id, a.id, count(*) as k from tx a join tx b on a.tile_id = b.tile_id and abs(a.x - b.x) < 5 and abs(a.y - b.y) < 5 and sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) < 5 group by 1, 2) group by 1),
tb as (select tile_id, sum(least(k, 3)) as n_tx_bd from (select a.tile_id, a.id, count(*) as k from tx a join bd b on a.tile_id = b.tile_id and sqrt(power(a.x - cx, 2) + power(a.y - cy, 2)) < reach group by 1, 2) group by 1),
po as (select tx.tile_id, count(*) as n_belongs from tx join bd on bd.tile_id = tx.tile_id and bd.cell_id = tx.cell_id where nuclear = 1 and tx.tile_id in (select tile_id from tb) group by 1),
st as (select tt.tile_id, n_tx, coalesce(n_bd, 0) as n_bd, n_tx_tx, coalesce(n_tx_bd, 0) as n_tx_bd, coalesce(n_belongs, 0) as n_belongs from tt join (select tile_id, count(*) as n_tx from tx group by 1) q on q.tile_id = tt.tile_id
  left join (select tile_id, count(*) as n_bd from bd group by 1) d on d.tile_id = tt.tile_id left join tb on tb.tile_id = tt.tile_id left join po on po.tile_id = tt.tile_id)
select tile_id, case when n_belongs = 0 then 'test' when {share} < 700 then 'train' when {share} < 800 then 'val' else 'test' end as split, n_tx, n_bd, n_tx_tx::bigint as n_tx_tx, n_tx_bd::bigint as n_tx_bd, n_belongs from st"""


@query("q_create_dataset", _DATASET.format(edges=_EDGES, share=_SHARE))
def _(t):
    points = t.tx.withColumn("cell_id", F.col("nucleus_id"))
    return dataset.tile_graph(points, t.bd, 150, 120).tiles
