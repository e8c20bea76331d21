from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tests.oracle import compare, sql_connection


@pytest.fixture(scope="module")
def con():
    return sql_connection(SMALL)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) & set(entry.queries())))
def test_query_equals_its_sql(spark, con, name):
    problem, _ = compare(spark, con, SMALL, entry.queries()[name], entry.oracle_sql()[name])
    assert problem is None


def test_entry_returns_the_flagship_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "txn_count_30d" in df.columns
