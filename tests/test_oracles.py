"""Every query with SQL gives the rows of that SQL; the others run and give rows."""

import pytest
from oracle import connect, difference

import __spark_entry__ as contract

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(name, spark, sf, duck):
    assert difference(QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLES[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() == 3
