"""Every registered query against its SQL oracle, on whole tables."""

import os

import pytest

import __spark_entry__ as entry
from periodica.plans.queries import QUERIES
from tests.compare import connect, differences, oracle_result, spark_result

FOLDER = os.environ.get("CHECK_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_oracle(spark, con, name):
    got = spark_result(entry.queries()[name](spark, FOLDER))
    want = oracle_result(con, entry.oracle_sql()[name])
    assert differences(got, want) == []
    assert want[1], "an empty result checks nothing"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
