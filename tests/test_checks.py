"""Every registered query against its SQL at the smallest size."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.run import compare, connect

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, con, name):
    ok, note = compare(spark, con, queries()[name], SQL.get(name), SF)
    assert ok, note


def test_entry(spark):
    assert entry(spark).count() > 0
