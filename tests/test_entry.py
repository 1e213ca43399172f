"""The catalogue against DuckDB on the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_point
from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_duckdb(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), con.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    order = lambda d: d[cols].astype(object).sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
