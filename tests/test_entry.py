"""Every registered query that has SQL against that SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    own = duckdb.connect()
    for name in os.listdir(FOLDER):
        own.execute(f"create view {name.split('.')[0]} as select * from '{FOLDER}/{name}'")
    return own


def plain(rows):
    return sorted(repr(tuple(float(x) if type(x).__name__ == "Decimal" else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_rows_equal_sql(spark, sql, name):
    got = entry.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = sql.execute(f"select {', '.join(columns)} from ({entry.oracle_sql()[name].strip()})").fetchall()
    assert plain(got.select(*columns).collect()) == plain(want)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_queries_without_sql_run(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() == 24
