"""Every registered query against DuckDB's answer on the smallest tables."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__
from tablecare.plans import catalog

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    queries, sql = catalog.load()
    assert set(queries) == set(sql)
    assert set(queries) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query(spark, con, name):
    result = __spark_entry__.queries()[name](spark, FOLDER)
    assert compare(result, con, __spark_entry__.oracle_sql()[name]) is None


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
