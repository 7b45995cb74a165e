"""Every registered query against its DuckDB statement."""

import pytest

import __spark_entry__ as contract
from tests.compare import differences, duck

SMALL = "/root/testdata/sf0.001"
ORACLES = contract.oracle_sql()
QUERIES = {name: query for name, query in contract.queries().items() if name not in contract.LLM_QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES) - set(contract.LLM_ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, con, name):
    assert differences(QUERIES[name](spark, SMALL), con, ORACLES[name]) == []


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
