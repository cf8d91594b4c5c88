"""Every core query with an SQL twin against DuckDB; those without run and have columns."""

import pytest
from helpers import DATA, same_as_sql

from parchmill.plans import catalog

SQL = catalog.oracle_sql()
QUERIES = catalog.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    same_as_sql(spark, duck, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
