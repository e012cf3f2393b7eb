"""Every named query against its SQL counterpart on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


def test_every_counterpart_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, db, name):
    expected = db.execute(entry.oracle_sql()[name]).fetchdf()
    assert difference(entry.queries()[name](spark, FOLDER).toPandas(), expected) == ""


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_rows_only(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0


def test_entry_is_lazy_and_has_rows(spark):
    assert entry.entry(spark).count() == 25
