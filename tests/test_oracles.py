"""Every query against its SQL, over the smallest tables."""

from __future__ import annotations

import pytest

from curves.plans.registry import ORACLES, QUERIES
from tests.compare import DATA, assert_same, connection


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert_same(QUERIES[name](spark, DATA), ORACLES[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
