"""Every registered query against its SQL form, and the driver contract."""

import pytest

import __spark_entry__ as entry
from tools.check_queries import compare, oracle_connection

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SF)


def test_sql_forms_belong_to_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 1829


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, oracle, name):
    assert compare(QUERIES[name](spark, SF).toPandas(), oracle.execute(SQL[name]).fetchdf()) == "ok"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
