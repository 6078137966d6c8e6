"""All registered queries against their SQL, on the smallest given tables."""

import pytest

import __spark_entry__ as entry_points
from checks.compare import compare, connect
from checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, connection, name):
    same, _, _, _, note = compare(spark, connection, SF_DIR, name)
    assert same, note


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(entry_points.oracle_sql()) <= set(entry_points.queries())
