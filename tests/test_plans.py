"""Shape of the physical plans."""

import re

import pytest
from pyspark.sql import functions as F

from incidentlab.geo import project_points
from incidentlab.rollup import attach_group
from incidentlab.tables import period_matrix
from suite import catalog

PLANNED = sorted(catalog.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_no_cartesian_and_no_python(spark, sf_dir, name):
    text = plan(catalog.queries()[name](spark, sf_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in text


def test_filter_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(catalog.queries()["scan_filtered"](spark, sf_dir))
    assert "EqualTo(n_regionkey,1)" in text
    assert "ReadSchema: struct<n_name:string,n_regionkey:int>" in text


def test_hot_key_is_split_when_totals_are_attached(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(60000, numPartitions=8).select(
            F.col("id"), F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id") % 500).alias("k")
        )
        out = attach_group(df, "k", {"n": F.count(F.lit(1))})
        assert out.where("k = -1 AND n = 30000").count() == 30000
        out = attach_group(df, "k", {"n": F.count(F.lit(1))})
        out.write.format("noop").mode("overwrite").save()
        rows = out.collect()
        assert len(rows) == 60000
        assert re.search(r"skew=true|isSkewJoin|SortMergeJoin\(skew", plan(out))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_projection_golden_point(spark):
    df = spark.createDataFrame([(1206953.625, 750434.8125)], "x double, y double")
    r = project_points(df, "x", "y").first()
    assert round(r.latitude, 6) == 47.377925 and round(r.longitude, 6) == -122.249638


def test_periods_are_counted_without_sorting_the_rows(spark):
    # a group may hold a third of all rows: only a hash table keeps its memory to the groups
    rows = [("a", "pre", "x", True), ("a", "pre", None, None), ("a", "pre", "w", True), ("a", "reform", None, False),
            ("b", "pre", None, True), (None, "pre", "z", True), ("a", None, "u", None)]
    df = spark.createDataFrame(rows, "agency string, period string, kind string, hit boolean")
    out = period_matrix(df, "agency", "period", ["pre", "reform"],
                        {"loose": (F.col("hit"), False), "strict": (F.col("hit"), True)}, attributes={"type": "kind"})
    got = {r.agency: r.asDict() for r in out.collect()}
    assert got["a"] == {
        "agency": "a", "type": "u", "fatalities_pre": 3, "loose_pre": 2, "strict_pre": None, "fatalities_reform": 1,
        "loose_reform": 0, "strict_reform": 0, "fatalities_tot": 4, "loose_tot": 2, "strict_tot": 0}
    assert got["b"]["type"] is None and got["b"]["strict_pre"] == 1 and got["b"]["fatalities_reform"] is None
    assert got[None]["type"] == "z" and got[None]["strict_tot"] == 1
    below = plan(out).split("Exchange")[-1]  # what reads the rows
    assert "HashAggregate" in below and "Sort" not in below
