"""Every registered query against its SQL counterpart on the smallest data set."""

import pytest
from conftest import SMALL

import __spark_entry__ as entry
import compare
from lendlane.catalog.oracle import ORACLES
from lendlane.catalog.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    return compare.connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare.differences(entry.queries()[name](spark, SMALL), con, ORACLES[name]) == []


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    # One cuts recursively, which its own test checks; the other is approximate: `index_recall` measures it.
    assert set(QUERIES) - set(ORACLES) == {"chunk_recursive", "knn_indexed"}


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
