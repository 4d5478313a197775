"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from oracle import connect, difference

import __spark_entry__ as entry_point

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_same_result(spark, con, name):
    assert difference(entry_point.queries()[name](spark, FOLDER), con, entry_point.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(entry_point.queries()) - set(entry_point.oracle_sql())))
def test_gives_rows(spark, name):
    assert len(entry_point.queries()[name](spark, FOLDER).limit(1).collect()) == 1


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
