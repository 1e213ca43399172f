"""The driver's tables re-read as points, outlines, cells and assignments.

Each view is one SQL text that gives the same rows in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_transcripts": (
        ("lineitem", "part"),
        """select cast(l_orderkey as bigint) * 1000000000 + l_linenumber * 100000000 + cast(round(l_extendedprice * 100) as bigint) as transcript_id,
       l_extendedprice / 100 as x,
       cast((year(l_shipdate) - 1995) * 372 + (month(l_shipdate) - 1) * 31 + day(l_shipdate) as double) * cast(0.4 as double) as y,
       l_quantity * cast(0.2 as double) as z,
       case p_brand when 'Brand#1' then 'NegControlProbe_1' when 'Brand#2' then 'BLANK_2' else p_brand end as gene,
       cast(round(l_discount * 100) * 4 as double) as qv,
       case when l_returnflag = 'R' then 1 else 0 end as nuclear,
       case when l_returnflag = 'N' and l_linestatus = 'F' then null else cast(l_orderkey as bigint) end as cell_id,
       cast(l_suppkey as bigint) as nucleus_id, l_returnflag as method
from lineitem join part on l_partkey = p_partkey""",
    ),
    "v_boundaries": (
        ("supplier",),
        """select cast(s_suppkey as bigint) as cell_id, v.i as vertex_idx,
       cast((s_suppkey * 37) % 100 * 10 + 5 as double) + cast(20 + s_suppkey % 15 as double) * cast(v.cx as double) as x,
       cast((s_suppkey * 61) % 100 * 10 + 5 as double) + cast(20 + s_suppkey % 15 as double) * cast(v.cy as double) as y
from supplier cross join (
  select 0 as i, 1.0 as cx, 0.0 as cy union all select 1, 0.7, 0.7 union all select 2, 0.0, 1.0 union all select 3, -0.7, 0.7
  union all select 4, -1.0, 0.0 union all select 5, -0.7, -0.7 union all select 6, 0.0, -1.0 union all select 7, 0.7, -0.7) v""",
    ),
    "v_cells": (
        ("orders", "customer"),
        """select cast(o_orderkey as bigint) as cell_id, o_orderpriority as cell_type, c_mktsegment as segment, o_totalprice / 1000 as area
from orders join customer on o_custkey = c_custkey""",
    ),
    "v_assignments": (
        ("lineitem",),
        """select cast(l_orderkey as varchar(20)) as transcript_id, round(l_discount * 8 + l_tax, 3) as score,
       cast(l_suppkey as varchar(20)) as cell_id, case when l_discount * 8 + l_tax >= 0.5 then 1 else 0 end as bound
from lineitem""",
    ),
}

PREFIXES = ("NegControlProbe_", "BLANK_")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, text = VIEWS[name]
    return spark.sql(_named(text, tables), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def _named(text: str, tables: tuple[str, ...]) -> str:
    """Table names as parameters: no temporary view is left behind."""
    import re

    for t in tables:
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
    return text


def oracle(sql: str) -> str:
    """SQL over the views, with those it names as common table expressions."""
    used = [n for n in VIEWS if n in sql]
    ctes = ", ".join(f"{n} as ({VIEWS[n][1]})" for n in used)
    body = sql.strip()
    if not used:
        return body
    if body.lower().startswith("with recursive"):
        return f"with recursive {ctes}, {body[len('with recursive'):]}"
    if body.lower().startswith("with "):
        return f"with {ctes}, {body[len('with '):]}"
    return f"with {ctes} {body}"
