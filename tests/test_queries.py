"""Every registered query with SQL agrees with DuckDB on the same Parquet tables."""

import pytest

import __spark_entry__ as entry
import check
from conftest import SF

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert check.compare(entry.queries()[name](spark, SF), con, SQL[name]) == ""


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5 * 500 and set(rows[0].asDict()) == {"entity", "other", "rank", "d"}
