"""Queries with SQL agree with DuckDB; every opN_ query is registered."""

import oracle
import pytest

import __spark_entry__
from tessera.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    oracle.same(queries.queries()[name](spark, SF), oracle.connected(SF), queries.oracle_sql()[name])


def test_all_are_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
