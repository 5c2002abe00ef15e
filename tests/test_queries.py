"""Every registered query that has a SQL twin agrees with it on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from compare import differences

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert not differences(QUERIES[name](spark, FOLDER), FOLDER, SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
