"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, duck_tables

# The optional modules have tests of their own.
OWN = {name for module in entry._optional() for name in module.QUERIES}
QUERIES = {name: run for name, run in entry.queries().items() if name not in OWN}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name not in OWN}


@pytest.fixture(scope="module")
def db(sf):
    return duck_tables(sf)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, db, name):
    good, text = compare(QUERIES[name](spark, sf), ORACLES[name], db)
    assert good, text


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "o_orderkey" and df.count() > 0
