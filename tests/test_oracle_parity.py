"""Every registered query against its SQL oracle at the smallest scale."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry
from logspark.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.QUERIES, entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    difference = compare(spark, con, QUERIES[name], ORACLES[name], SF_DIR, allow_empty=True)
    assert difference is None, difference


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
