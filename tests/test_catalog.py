"""Every catalog query against its SQL over the whole table."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import check

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF_DIR}/events.parquet'")
    return con


# The training-data operators have tests of their own.
NAMES = sorted(set(entry.queries()) - set(entry.LLM_QUERIES))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    verdict, rows, _ = check.compare(spark, con, name, SF_DIR)
    assert verdict == "ok"
    assert rows > 0


def test_every_query_has_sql():
    assert set(NAMES) <= set(entry.oracle_sql())


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["consumer_id", "index_name", "last_ts", "last_id", "total"]
    assert frame.count() > 0
