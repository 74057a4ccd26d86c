"""The driver contract: every query runs on the smallest data, and its SQL has the same columns."""

import pytest

import __spark_entry__ as entry
from corvane.plans import registry

DATA = "/root/testdata/sf0.001"
SLOW = {"hybrid_search", "graph_search"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - SLOW))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, DATA).limit(5).collect() is not None
