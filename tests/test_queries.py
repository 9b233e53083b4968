"""Every registered query against its SQL, on the supplied tables."""

import pytest

import __spark_entry__
import oracle

FOLDER = "/root/testdata/sf0.001"
QUERIES = __spark_entry__.QUERIES
SQL = __spark_entry__.ORACLES


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(FOLDER)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    assert oracle.differences(QUERIES[name](spark, FOLDER), connection, SQL[name]) is None


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
