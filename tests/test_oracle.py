from __future__ import annotations

import pytest

import __spark_entry__ as entry
from inkstrata.plans import ORACLE_SQL, QUERIES
from oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_twin(spark, con, name):
    assert compare(QUERIES[name](spark, SF), ORACLE_SQL[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    QUERIES[name](spark, SF).collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
