"""Every query with SQL gives the same rows in both engines on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.check_oracles import differences, duck

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query(spark, con, name):
    found = differences(entry.queries()[name](spark, SF_DIR), entry.oracle_sql()[name], con)
    assert found is None


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
