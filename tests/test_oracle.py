"""Every registered dialect query against DuckDB on the small tables."""

import decimal
import os

import duckdb
import pytest

from tessella import queries as dialect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in dialect.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    return int(v) if isinstance(v, (float, decimal.Decimal)) and v == int(v) else v


@pytest.mark.parametrize("name", sorted(dialect.queries()))
def test_same_rows_as_duckdb(spark, duck, name):
    frame = dialect.queries()[name](spark, SF_DIR)
    want = duck.sql(dialect.oracle_sql()[name])
    columns = sorted(frame.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted(repr([plain(v) for v in r]) for r in frame.select(*[f"`{c}`" for c in columns]).collect())
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())
