"""Every registered query against its SQL counterpart on the smallest tables."""

import pytest
from conftest import SMALL
from oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SMALL)
    sql = oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(df, con, sql) is None


def test_entry(spark):
    assert entry(spark).count() == 8
