"""Every query with a SQL twin equals it; every other one runs."""

import pytest
from compare import compare, connect

from shelfgrid.queries import spark_queries, sql_queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(sql_queries()))
def test_equals_sql(spark, duck, name):
    ok, text = compare(spark, duck, DATA, name)
    assert ok, text


def test_all_registered_and_named():
    assert set(sql_queries()) <= set(spark_queries())
    assert len(spark_queries()) > 120
