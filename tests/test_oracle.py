"""Every query with a SQL counterpart gives the same rows as it."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, normal

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not there")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, db, name):
    df = entry.queries()[name](spark, SMALL)
    rows, columns = normal([tuple(r) for r in df.collect()], df.columns)
    cursor = db.execute(entry.oracle_sql()[name])
    want, want_columns = normal(cursor.fetchall(), [d[0] for d in cursor.description])
    assert columns == want_columns
    assert rows == want


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 9
