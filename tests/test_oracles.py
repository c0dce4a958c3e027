"""Every named query against its SQL on the smallest tables, whole results."""

import pytest

import __spark_entry__ as entry
import check_oracles as co

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return co.connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    message, _, ok = co.compare(spark, con, SF, name, entry.queries()[name], SQL.get(name))
    assert ok, message


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
