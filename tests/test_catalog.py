"""Every registered query runs; where it has SQL, DuckDB must give the same rows."""

import os

import pytest
from compare import compare, connect

from shoal import catalog

SF_DIR = os.environ.get("SHOAL_TEST_SF_DIR", "/root/testdata/sf0.01")
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    return connect(SF_DIR)


def test_every_sql_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    result = QUERIES[name](spark, SF_DIR)
    if name in SQL:
        assert compare(result, con, SQL[name]) is None
    else:
        assert result.count() > 0
