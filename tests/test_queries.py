"""Every query that has SQL agrees with DuckDB on whole tables; the others run."""

import os

import oracle
import pytest

from tessera import queries

queries.load()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return oracle.connected(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, connection, name):
    df = queries.QUERIES[name](spark, SF)
    if name in queries.SQL:
        oracle.same(df, connection, queries.SQL[name])
    else:
        assert df.count() > 0
