"""Every registered query next to its SQL twin on the smallest data."""

from __future__ import annotations

import os

import pytest
from compare import connect, difference

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(name, spark, con):
    df = entry.queries()[name](spark, SF_DIR)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        problem = difference(df, con, sql)
        # Small data may leave a filter without rows on both sides.
        assert problem in (None, "both empty"), problem


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0
