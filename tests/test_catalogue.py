"""The query catalogue: every query has SQL, and gives what it gives."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as catalogue

DATA = "/root/testdata/sf0.001"
TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events")


def test_every_query_has_sql():
    """But for operators on training data, some of which SQL cannot express; these are held
    against brute force in their own tests."""
    queries = {n for n in catalogue.queries() if not re.match(r"op\d+_|pipeline$", n)}
    assert queries <= set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_queries_do_not_limit_their_input():
    for sql in catalogue.oracle_sql().values():
        assert "USING SAMPLE" not in sql


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("test tables are not here")
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", [n for n in catalogue.oracle_sql() if not re.match(r"op\d+_|pipeline$", n)])
def test_query_equals_its_sql(spark, con, name):
    df = catalogue.queries()[name](spark, DATA)
    cursor = con.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted(map(repr, cursor.fetchall()))
    picked = [df.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[i] for i in picked)) for r in df.collect()) == expected


def test_entry_runs(spark):
    if not os.path.isdir(DATA):
        pytest.skip("test tables are not here")
    df = catalogue.entry(spark)
    assert df.columns == ["doc_no", "old_no", "partner", "urgency", "doc_date", "amount"]
    assert df.count() > 0
