"""Every query with SQL gives what the SQL gives; the others run."""

import pytest

import __spark_entry__ as entry
from tests.oracle import assert_same, connect

QUERIES = {name: query for plans in entry.PLANS for name, query in plans.QUERIES.items()}
SQL = {name: sql for plans in entry.PLANS for name, sql in plans.ORACLE_SQL.items()}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, con, name):
    assert_same(QUERIES[name](spark, sf), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "chunk_id", "rank", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
