"""Every query with SQL gives the same rows in DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, con, name):
    assert compare(spark, SF, name, entry.queries()[name], entry.oracle_sql()[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, name):
    entry.queries()[name](spark, SF).count()


def test_entry(spark):
    assert entry.entry(spark).columns == ["field_name", "key_value"]
