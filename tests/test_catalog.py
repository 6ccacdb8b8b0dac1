import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect
from urlsieve.catalog import all_oracles, all_queries

SQL = all_oracles()


def test_every_query_is_named_once():
    assert set(SQL) <= set(oracle_sql()) <= set(queries())
    assert set(all_queries()) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, name):
    got = queries()[name](spark, sf).toPandas()
    assert compare(got, connect(sf).execute(SQL[name]).df()).startswith("ok")


def test_entry(spark):
    assert entry(spark).count() > 0
