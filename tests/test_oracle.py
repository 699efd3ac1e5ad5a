"""Every registered query equals its SQL on DuckDB."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import connect, difference

SF_DIR = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_equals_sql(spark, con, key):
    assert difference(spark, con, SF_DIR, queries()[key], SQL[key]) is None


def test_entry_gives_the_draft_map(spark):
    rows = entry(spark)
    assert rows.columns == ["draft_id", "token", "token_id", "freq", "offset"]
    assert rows.count() == 500
