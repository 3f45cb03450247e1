"""Every registered query against its SQL in DuckDB."""

import pytest

import __spark_entry__ as spark_entry
from changefeed.plans.registry import ORACLES, QUERIES
from tools.check_queries import check, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_agrees_with_sql(spark, con, sf_dir, name):
    ok, text = check(spark, con, name, sf_dir)
    assert ok, text


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert spark_entry.entry(spark).count() == 3
