"""The registered corpus queries against their SQL, and their names."""

import pytest

import corpus_pipeline
from incidentlab.llm import queries
from suite.check import compare, connect


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf_dir, name):
    ok, note = compare(spark, connect(sf_dir), name, queries.QUERIES[name], queries.ORACLES[name], sf_dir)
    assert ok, note


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
