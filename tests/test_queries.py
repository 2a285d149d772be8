"""Every query against its SQL; those without SQL must give rows."""

import pytest
from compare import database, difference

from __spark_entry__ import entry, oracle_sql, queries


@pytest.fixture(scope="module")
def con(tables):
    return database(tables)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, tables, con, name):
    df = queries()[name](spark, tables)
    sql = oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert difference(df, con, sql) is None


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark, tables):
    assert entry(spark).columns == ["userid", "window_start", "window_end", "score"]
