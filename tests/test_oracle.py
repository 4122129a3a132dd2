"""Every registered query against its SQL, on even data and on data with hot keys."""

from __future__ import annotations

import pytest

from oracles.statements import all_statements
from stallworks.registry import registered_queries
from tests.compare import connect, difference

QUERIES = registered_queries()
SQL = all_statements()


def test_every_query_has_sql_and_every_sql_a_query():
    assert set(QUERIES) == set(SQL)


@pytest.fixture(scope="module")
def even(check_dir):
    return check_dir, connect(check_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_even_data(spark, even, name):
    folder, con = even
    assert difference(QUERIES[name](spark, folder), con, SQL[name]) is None


@pytest.fixture(scope="module")
def hot(hot_dir):
    return hot_dir, connect(hot_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_hot_keys(spark, hot, name):
    folder, con = hot
    assert difference(QUERIES[name](spark, folder), con, SQL[name]) is None
