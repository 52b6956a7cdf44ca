"""Every registered query against its SQL on the smallest tables; queries without SQL must run."""

import pytest
from check import compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_smoke_query(spark):
    df = entry.entry(spark)
    assert df.columns == ["column", "category", "total", "positive", "rate"] and df.count() == 2


# fitting 100 boosted trees takes half a minute; tools/check.py runs it
SLOW = {"train_gbt"}


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, con, name):
    ok, message = compare(spark, con, FOLDER, name, QUERIES[name], SQL.get(name))
    assert ok, message
