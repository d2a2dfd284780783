"""Every named query next to its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from trackloom.plans.catalogue import catalogue
from scripts.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue()))
def test_query_equals_sql(spark, con, name):
    ok, text = compare(spark, con, FOLDER, name)
    assert ok or text.startswith("0 rows equal"), text


def test_entry(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
