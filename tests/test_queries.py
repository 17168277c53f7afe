"""Every registered core query: against its SQL where there is one, else that it runs with a stable schema."""

from __future__ import annotations

import pytest
from oracle import assert_same, connect

from corpusloom.plans import registry

QUERIES, SQL = registry.queries(), registry.sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_registry_is_consistent():
    assert set(SQL) <= set(QUERIES)
    assert registry.FLAGSHIP in QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, con, name):
    assert_same(QUERIES[name](spark, sf).toPandas(), con.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0
