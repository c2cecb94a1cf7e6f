"""Queries that SQL can express, against DuckDB."""

import os

import duckdb
import pytest

from cohortgeo.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables aren't here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(want.columns)
    rows = lambda t: sorted(tuple("" if x is None or x != x else str(x) for x in r) for r in t[order].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)
