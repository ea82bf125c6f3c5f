"""Corrections by rules, periods from a table, breakdowns from one read, layouts read as one table."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from incidentlab import corrections, io, link, ordering, periods, tables
from incidentlab.flows import national
from incidentlab.rollup import propagate
from suite import catalog

RULE = "inc string, rule int, column_name string, op string, value string, unit array<int>, age int"
ROWS = [("a", 1, 20, 2, "F"), ("a", 2, None, 3, None), ("a", 7, 25, None, "F"), ("b", 1, 5, 1, "M"), (None, 1, 5, 9, "M")]
COLUMNS = "inc string, unit int, age int, persons int, sex string"


def fixed(spark, rules, **options):
    df = spark.createDataFrame(ROWS, COLUMNS)
    out = corrections.correct(df, spark.createDataFrame(rules, RULE), "inc", ["persons", "sex"],
                              conditions=["unit", "age"], **options)
    assert out.columns == df.columns
    return {(r.inc, r.unit): (r.persons, r.sex) for r in out.collect()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df):
    return plan(df).split("Initial Plan")[0].count("FileScan")


def test_rules_apply_by_their_conditions(spark):
    assert fixed(spark, [
        ("a", 1, "persons", "add", "3", None, None), ("a", 2, "sex", "set", "M", None, 25),
        ("a", 3, "sex", "missing", None, [1, 6], None), ("zz", 1, "sex", "set", "M", None, None),
        ("a", 9, "other", "set", "M", None, None),
    ]) == {("a", 1): (5, None), ("a", 2): (6, None), ("a", 7): (None, "M"), ("b", 1): (1, "M"), (None, 1): (9, "M")}


def test_rules_on_one_cell_apply_in_order_or_fail(spark):
    rules = [("a", 5, "persons", "add", "1", [1], None), ("a", 2, "persons", "set", "10", None, None),
             ("a", 7, "persons", "missing", None, [2], None), ("b", 1, "persons", "set", "x", None, None)]
    got = fixed(spark, rules)
    assert [got[k][0] for k in (("a", 1), ("a", 2), ("a", 7), ("b", 1))] == [11, None, 10, None]
    with pytest.raises(Exception, match="several rules for persons of a"):
        fixed(spark, rules, conflicts="fail")
    assert fixed(spark, rules[3:], conflicts="fail")["a", 1] == (2, "F")
    with pytest.raises(ValueError):
        fixed(spark, rules, conflicts="smallest")


@pytest.mark.parametrize("rule, match", [
    ([("a", 1, "sex", "set", "M", None, None)] * 2, "one number"),
    ([("a", 1, "sex", "swap", "M", None, None)], "known operation"),
    ([("a", 1, "sex", "set", None, None, None)], "value"),
    ([(None, 1, "sex", "set", "M", None, None)], "key"),
    ([("a", 1, "sex", "add", "1", None, None)], "no number"),
])
def test_wrong_rules_are_errors(spark, rule, match):
    with pytest.raises(Exception, match=match):
        fixed(spark, rule)


def test_periods_of_a_table(spark):
    day = date(2020, 1, 1)
    rows = [(i, None if i == 0 else day + timedelta(days=i - 5)) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, day date")
    table = [("p1", day, day + timedelta(days=70)), ("gap after", day + timedelta(days=70), day + timedelta(days=75)),
             ("open", day + timedelta(days=90), None), ("empty", day, day)]
    spans = spark.createDataFrame(table, "period string, from_date date, to_date date")
    for bucket in (1, 7, 32, 4000):
        out = periods.label_from_table(df, "day", spans, bucket_days=bucket)
        got = {r.id: r.period for r in out.collect()}
        assert len(got) == out.count() == 120
        for i, d in rows:
            want = [p for p, a, b in table if d and a <= d and (b is None or d < b)]
            assert got[i] == (want[0] if want else None)
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)


def test_overlapping_periods(spark):
    day = date(2020, 1, 1)
    table = [(f"p{i:02}", day + timedelta(days=i * 3 % 40), day + timedelta(days=i * 3 % 40 + 17)) for i in range(40)]
    spans = spark.createDataFrame([*table, ("q", day, day + timedelta(days=2))], "period string, from_date date, to_date date")
    df = spark.createDataFrame([(i, day + timedelta(days=i)) for i in range(80)], "id int, day date")
    with pytest.raises(Exception, match="overlap"):
        periods.label_from_table(df, "day", spans).collect()
    table.append(("q", day, day + timedelta(days=2)))
    for bucket in (1, 5, 64):
        got = periods.label_from_table(df, "day", spans, overlap="later", bucket_days=bucket).collect()
        assert len(got) == 80
        for r in got:
            # a period ends where a later one begins, even if that one is shorter
            begun = [(a, p, b) for p, a, b in table if a <= r.day]
            a, p, b = max(begun) if begun else (None, None, None)
            assert r.period == (p if b and r.day < b else None), (r, bucket)


def test_breakdowns_equal_single_ones_from_one_read(spark, tmp_path):
    path = str(tmp_path / "rows.parquet")
    spark.range(500).select(
        F.when(F.col("id") % 7 > 0, F.col("id") % 5).alias("a"), F.concat(F.lit("x"), F.col("id") % 3).alias("b"),
        F.when(F.col("id") % 4 > 0, F.col("id") % 2).alias("victim")).write.parquet(path)
    df = spark.read.parquet(path)
    out = tables.breakdowns(df, ["a", "b"], "victim")
    got = {tuple(r) for r in out.collect()}
    want = set()
    for d in ("a", "b"):
        for r in tables.breakdown(df, d, "victim").collect():
            want.add((d, None if r[d] is None else str(r[d]), r.victim, r.Number, r.Total, r.Percent))
    assert got == want and scans(out) == 1
    assert tables.breakdowns(df, ["a"], "victim", min_total=80).count() < tables.breakdowns(df, ["a"], "victim").count()
    assert tables.breakdowns(df.limit(0), ["a", "b"], "victim").collect() == []
    with pytest.raises(ValueError):
        tables.breakdowns(df, ["a", "victim"], "victim")


def test_files_of_several_layouts_are_one_scan(spark, tmp_path):
    early = spark.createDataFrame([(2018, 1, 5)], "year int, id int, race int")
    paths = io.write_tables({"early": early, "late": early.select(F.lit(2019).alias("year"), "id")}, str(tmp_path))
    both = io.read_table(spark, list(paths.values()), early.schema)
    assert {tuple(r) for r in both.collect()} == {(2018, 1, 5), (2019, 1, None)} and scans(both) == 1


def test_national_files_are_read_once_per_kind(spark, sf_dir):
    out = catalog.queries()["flow_national"](spark, sf_dir)
    assert scans(out) <= 8
    assert national.Eras() == national.Eras(2019, 2020)


def test_rows_are_moved_once_for_a_global_number(spark, monkeypatch):
    seen = []
    kept = ordering.stage
    monkeypatch.setattr(ordering, "stage", lambda df: seen.append(plan(df)) or kept(df))
    ordering.number_global(spark.range(60000), ["id"]).count()
    assert len(seen) == 1 and seen[0].count("Exchange") == 1 and "Exchange rangepartitioning" in seen[0]


def test_linkage_numbers_both_sides_in_one_window(spark):
    left = spark.range(50).select(F.col("id").alias("l"), (F.col("id") % 7).alias("k"))
    right = spark.range(40).select(F.col("id").alias("r"), (F.col("id") % 5).alias("k"))
    text = plan(link.link_full(left, right, ["k"], "l", "r")).split("Initial Plan")[0]
    assert len([x for x in text.split("\n") if "Window [" in x or "Window(" in x]) == 1
    assert "Join" not in text


def test_presence_reads_each_side_once(spark, tmp_path):
    for name in ("l", "r"):
        spark.range(9).select("id", F.lit(1).alias(f"v{name}")).write.parquet(str(tmp_path / name))
    left, right = (spark.read.parquet(str(tmp_path / n)) for n in "lr")
    out = link.join_presence(left, right.withColumnRenamed("id", "key"), {"id": "key"}, "there")
    assert scans(out) == 2 and out.count() == 9


def test_propagation_combines_unit_aggregates(spark):
    df = spark.createDataFrame(
        [(1, 1, 1, 5), (1, 1, 0, 6), (1, 2, 0, 7), (2, None, 1, 8), (2, 3, None, 9)], "inc int, unit int, flag int, v int")
    out = propagate(df, "inc", F.col("flag") == 1, "unit",
                    aggs={"n": (F.count(F.lit(1)), F.sum), "most": (F.max("v"), F.max)})
    assert {(r.inc, r.v): (r.flagged_unit, r.flagged_units, r.in_flagged_unit, r.n, r.most) for r in out.collect()} == {
        (1, 5): (1, 1, 1, 3, 7), (1, 6): (1, 1, 1, 3, 7), (1, 7): (1, 1, 0, 3, 7),
        (2, 8): (None, 1, 1, 2, 9), (2, 9): (None, 1, 0, 2, 9)}
