"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(ROOT)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, con, name):
    ok, message = compare(spark, con, name, entry.queries(), entry.oracle_sql(), ROOT)
    assert ok, message


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 4
