"""Every query of the reference's operators against DuckDB."""

import importlib

import pytest

from epistrata.plans import core_queries, register
from tests import sqlcheck

for name in ("scalar", "window", "episode", "aggregate", "join", "source", "stream", "pipeline"):
    importlib.import_module(f"epistrata.plans.{name}_queries")

QUERIES, ORACLES = register.QUERIES | core_queries.QUERIES, register.ORACLES | core_queries.ORACLES


@pytest.fixture(scope="module")
def con():
    return sqlcheck.connect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    sqlcheck.same(QUERIES[name](spark, sqlcheck.SF).toPandas(), con.execute(ORACLES[name]).df())


def test_twins_have_queries():
    assert set(ORACLES) <= set(QUERIES)
