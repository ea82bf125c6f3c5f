"""Conventions on missing values, one small frame each."""

from pyspark.sql import functions as F

from incidentlab import clean, link, tables
from incidentlab.flows.state_crash import injury_label
from incidentlab.rollup import first_by, rollup_incidents
from incidentlab.rsem import (
    first_match, if_else_na, known_level, level_rank, matches, natural_join, null_safe_join, paste,
    strict_count,
)


def column(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_missing_keys_match(spark):
    a = spark.createDataFrame([(1, None), (2, 5)], "a int, k int")
    b = spark.createDataFrame([(10, None), (11, 6)], "b int, k int")
    got = {(r.a, r.b, r.k) for r in null_safe_join(a, b, ["k"], "full_outer").collect()}
    assert got == {(1, 10, None), (2, None, 5), (None, 11, 6)}


def test_natural_join_pins_keys(spark):
    a = spark.createDataFrame([(1, 2)], "a int, k int")
    try:
        natural_join(a, a, expect=["a"])
    except ValueError as exc:
        assert "expected join keys" in str(exc)
    else:
        raise AssertionError("a changed key list must be refused")


def test_regex_on_missing_is_false(spark):
    df = spark.createDataFrame([("After",), (None,)], "t string")
    assert column(df, matches("t", "After")) == [True, False]
    assert column(df, ~matches("t", "After")) == [False, True]


def test_choice_keeps_unknown(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    assert column(df, if_else_na(F.col("x") == 1, F.lit(1), F.lit(0))) == [1, 0, None]
    assert column(df, first_match([(F.col("x") == 1, "a")], "z")) == ["a", "z", "z"]


def test_any_code_is_three_valued(spark):
    df = spark.createDataFrame([(37, None), (1, None), (1, 2)], "a int, b int")
    assert column(df, clean.any_code(["a", "b"], 37)) == [1, None, 0]


def test_strict_count(spark):
    df = spark.createDataFrame([("a", "S"), ("a", "S"), ("b", "S"), ("b", None)], "g string, v string")
    got = dict(df.groupBy("g").agg(strict_count(F.col("v") == "S")).collect())
    assert got == {"a": 2, "b": None}


def test_levels(spark):
    df = spark.createDataFrame([("b",), ("z",), (None,)], "v string")
    assert column(df, level_rank("v", ["a", "b"])) == [2, None, None]
    assert column(df, known_level("v", ["a", "b"])) == ["b", None, None]


def test_paste_writes_na(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert column(df, paste("a", "b", sep="-")) == ["1-NA"]


def test_first_keeps_the_first_rows_missing_value(spark):
    df = spark.createDataFrame([(1, 2, "x"), (1, 1, None), (2, None, "y")], "k int, o int, v string")
    got = dict(first_by(df, "k", ["o"], ["v"]).collect())
    assert got == {1: None, 2: "y"}


def test_injury_order_sees_non_before_no(spark):
    df = spark.createDataFrame([("Non-Incapacitating",), ("No Injury",), ("no",), (None,)], "t string")
    assert column(df, injury_label("t")) == ["minor injury", "no injury", "Unknown", "Unknown"]


def test_incident_sums_stay_missing(spark):
    cols = "rec_id string, incident_num int, vpursuit string, incident_type string, victim string, injury string"
    df = spark.createDataFrame([
        ("1", 1, "Active pursuit", "Pursuit vehicular fatality", "Passenger", None),
        ("2", 1, "Active pursuit", "Pursuit vehicular fatality", None, "Subject"),
        ("3", 2, "Reviewed not related", "All other fatalities", "Subject", None),
    ], cols)
    first = {c: c for c in ("vpursuit", "incident_type")}
    got = {r.incident_num: r for r in rollup_incidents(df, first_columns=first).collect()}
    assert got[1].passengers_killed is None and got[1].pbo_any is None and got[1].total_injuries == 1
    assert got[1].subjects_killed == 0 and got[2].subjects_killed is None


def test_larger_count_survives(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (7, 5), (None, None)], "a int, b int")
    got = [r.w for r in link.survive(df, {}, {"w": ["a", "b"]}).collect()]
    assert got == [1, 5, 7, None]


def test_missing_level_is_counted(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("a", "b")], "x string, y string")
    got = {(r.x, r.y): r.n for r in link.quality_crosstab(df, "x", "y").collect()}
    assert got == {("a", None): 2, ("a", "b"): 1}


def test_share_table_total(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "x string")
    got = {r.x: (r.Number, r.Percent) for r in tables.share_table(df, "x").collect()}
    assert got == {"a": (2, "66.7%"), None: (1, "33.3%"), "Total": (3, "100.0%")}
