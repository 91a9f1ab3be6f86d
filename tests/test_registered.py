"""Every registered query against its SQL on the smallest data set."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from tests.compare import connect, differences

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()
STATED_ONLY: set[str] = set()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_sql_or_is_listed():
    assert {q for q in set(QUERIES) - set(ORACLES) if q not in contract.LLM_QUERIES} == STATED_ONLY
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - set(contract.LLM_ORACLES)))
def test_matches_sql(spark, sf, con, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert differences(got, con.execute(ORACLES[name]).fetchdf()) == []


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["query_id", "rank", "id", "similarity"]
    assert df.count() > 0
