"""Every registered query against its SQL twin on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as driver
from tablewright.queries.base import TABLES
from tools.check_queries import rows

ORACLE = driver.oracle_sql()
QUERIES = driver.queries()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, con):
    df = QUERIES[name](spark, sf)
    got, cols = rows([tuple(r) for r in df.collect()], df.columns)
    if name not in ORACLE:
        assert got
        return
    rel = con.execute(ORACLE[name])
    want, want_cols = rows(rel.fetchall(), [d[0] for d in rel.description])
    assert cols == want_cols
    assert got == want


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert driver.entry(spark).columns == ["segment", "total_amount"]
