"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from suite import catalog
from suite.check import compare, connect

QUERIES, ORACLES = catalog.queries(), catalog.oracles()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, sf_dir, name):
    ok, note = compare(spark, duck, name, QUERIES[name], ORACLES[name], sf_dir)
    assert ok, note


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_runs(spark):
    rows = {r["side"]: r["Total"] for r in entry.entry(spark).collect()}
    assert set(rows) == {"Pre-reform", "Post-reform"} and min(rows.values()) > 0
