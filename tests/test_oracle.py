"""Every registered query with SQL gives the same rows in Spark and DuckDB on the whole tables."""

import os

import pytest

import __spark_entry__ as entry
from tools.check_oracle import compare, connect

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    verdict, message, _, rows = compare(spark, duck, name, QUERIES[name], ORACLES.get(name), SF)
    assert verdict in ("ok", "rows"), message
    assert not message, message


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
