"""Every registered query against its SQL form on the smallest driver tables."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from logloom.plans.registry import ORACLES, QUERIES

DIRECTORY = os.environ.get("LOGLOOM_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="driver tables not present")


@pytest.fixture(scope="module")
def db():
    return connect(DIRECTORY)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    problem, *_ = compare(spark, db, QUERIES[name], ORACLES.get(name), DIRECTORY)
    assert problem is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
