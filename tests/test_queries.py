"""Every query against its SQL, and those without SQL for their shape."""

import pytest

from tessera.plans import catalogue, chain, learning, pixels

SQL = catalogue.oracle_sql() | chain.oracle_sql() | learning.oracle_sql() | pixels.oracle_sql()
QUERIES = catalogue.queries() | chain.queries() | learning.queries() | pixels.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, same_rows):
    same_rows(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql(name, spark, data):
    df = QUERIES[name](spark, data)
    assert df.count() > 0 and df.columns


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
