"""Every registered query against its SQL counterpart on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import differences, open_tables

FOLDER = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def tables():
    return open_tables(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, tables, name):
    df = queries()[name](spark, FOLDER)
    if name in SQL:
        assert differences(df, tables, SQL[name]) == []
    else:
        assert df.columns and len(df.collect()) > 0


def test_entry(spark):
    assert entry(spark).count() > 0
