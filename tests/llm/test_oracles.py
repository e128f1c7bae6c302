"""Training-data queries against their SQL."""

import pytest
from compare import compare, connect

from logspark.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(SF_DIR), queries.QUERIES[name], queries.ORACLES[name], SF_DIR) is None


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
