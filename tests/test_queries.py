"""Every registered query against its SQL, on whole tables."""

import os

import __spark_entry__ as registry
import compare
import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query_matches_sql(spark, con, name):
    cols, rows = compare.rows_of_spark(registry.queries()[name](spark, SF))
    assert rows
    if name in SQL:
        sql_cols, sql_rows = compare.rows_of_sql(con, SQL[name])
        assert cols == sql_cols
        assert rows == sql_rows


def test_sql_has_no_stray_names():
    assert set(SQL) <= set(registry.queries())


def test_entry_runs(spark):
    assert registry.entry(spark).count() > 0
