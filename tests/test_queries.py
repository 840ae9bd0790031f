"""Every registered observation query against its SQL."""

import pytest
from compare import assert_same, database

import __spark_entry__ as entry
from obsframe.plans import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(FOLDER)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_matches_sql(spark, db, name):
    assert_same(entry.queries()[name](spark, FOLDER), db, entry.oracle_sql()[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_filter_reaches_the_scan(spark):
    plan = queries.c02_filter_date(spark, FOLDER)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan and "props" not in plan.split("ReadSchema")[1].split("\n")[0]
