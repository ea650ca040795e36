"""Every named query against its SQL, by value, on whole tables."""

from __future__ import annotations

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import connect, difference
from tidewagon.plans.queries import named_queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(named_queries()))
def test_same_rows(spark, con, name):
    assert name in oracle_sql()
    assert difference(queries()[name](spark, FOLDER), con, oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
