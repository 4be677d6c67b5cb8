"""Every registered query against its SQL on the small tables."""

import pytest

import __spark_entry__ as entry_points
from oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
ORACLES = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert compare(entry_points.queries()[name](spark, SF_DIR), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(entry_points.queries()) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert entry_points.queries()[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() == 20
