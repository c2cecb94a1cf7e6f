"""Every query against its SQL in DuckDB, at the smallest scale, and golden values."""

import os

import duckdb
import pytest

from cohortgeo.plans import catalogue, protocols  # noqa: F401  (both register their queries)

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


def rows(table):
    def value(x):
        if x is None or x != x:
            return ""
        return f"{float(x):.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(value(x) for x in r) for r in table[sorted(table.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA).toPandas()
    if name in catalogue.oracle_sql():
        want = duck.execute(catalogue.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_golden_values(spark):
    r = catalogue.queries()["sns_all"](spark, DATA).first()
    assert (r["rows"], r["groups"], r["transitions"]) == (434, 10, 70)
    assert r["sns"] == pytest.approx(0.4908673072958788, abs=1e-8)
    assert catalogue.queries()["margin_nested"](spark, DATA).first()["margin"] == pytest.approx(-0.004817917734681067, abs=1e-8)


def test_split_golden(spark):
    """140/30/30 rows, found by an independent derivation."""
    m = catalogue.queries()["split_assignment"](spark, DATA)
    assert {r["split"]: r["count"] for r in m.groupBy("split").count().collect()} == {"train": 140, "validation": 30, "test": 30}
    assert m.select("dependency_group_id").distinct().count() == 156


def test_entry():
    import __spark_entry__ as e

    assert set(catalogue.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
