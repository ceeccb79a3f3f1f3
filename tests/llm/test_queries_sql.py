"""Queries of the test tables against DuckDB, where SQL can express them."""

import pytest

from epistrata.llm import oracles, queries
from tests import sqlcheck


@pytest.fixture(scope="module")
def con():
    return sqlcheck.connect()


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, con, name):
    sqlcheck.same(queries.QUERIES[name](spark, sqlcheck.SF).toPandas(), con.execute(oracles.ORACLES[name]).df())
