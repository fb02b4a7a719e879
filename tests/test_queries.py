"""Every registered query against its SQL statement at the smallest scale."""

import pytest

import __spark_entry__ as entry
from leasebook.plans import catalogue, checks
from tests.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_a_statement():
    assert set(catalogue.QUERIES) == set(checks.check_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, con, name):
    same, note = compare(spark, con, name, SF_DIR)
    assert same, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
