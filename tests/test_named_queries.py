"""Every query with an SQL twin gives the same rows as DuckDB."""

import pytest

import __spark_entry__ as entry
import oracle

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    said = oracle.difference(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF_DIR)
    assert said is None, said


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sql_only_for_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
