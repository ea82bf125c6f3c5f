"""How often rows are moved by the steps that the state flows and the linkage share."""

import re

import pytest
from pyspark.sql import functions as F

from incidentlab import link, rollup
from incidentlab.flows import agency_linkage, state_person
from suite import catalog

ROWS = [(1, 1, 1, 5), (1, 1, 0, 6), (1, 2, 0, 7), (1, 3, 1, 4), (1, 3, 1, 4), (2, None, 1, 8), (2, 3, None, 9),
        (3, 1, 0, 1), (None, 4, 1, 2), (None, 4, 0, 3), (None, None, 0, 3)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


def test_windows_and_joins_spread_the_same_flags(spark):
    df = spark.createDataFrame(ROWS, "inc int, unit int, flag int, v int")
    flagged, n, most = F.col("flag") == 1, F.count(F.lit(1)), F.max("v")
    joined = rollup.propagate(df, "inc", flagged, "unit", aggs={"n": (n, F.sum), "most": (most, F.max)})
    dealt = rollup.propagate_within(rollup.together(df, "inc"), "inc", flagged, "unit", aggs={"n": n, "most": most})
    key = repr
    assert sorted(map(key, joined.collect())) == sorted(map(key, dealt.select(*joined.columns).collect()))


def test_large_incident_is_left_to_the_joins(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, "inc int, unit int, flag int, v int")
    assert rollup.together(df, "inc") is not None
    monkeypatch.setattr(rollup, "RANGE_ROWS", 4)
    assert rollup.together(df, "inc") is None


@pytest.mark.parametrize("name, key", [
    ("flow_state_crash", "Collision Report Number"), ("flow_state_person", "par")])
def test_state_records_move_once_for_numbers_and_flags(spark, sf_dir, name, key):
    moves = re.findall(r"Exchange hashpartitioning\(([^\n]*)", plan(catalog.queries()[name](spark, sf_dir)))
    assert len([m for m in moves if key in m]) == 1


# par, year, record: unit 1 of p flees by its own factor, the supplement brings its own factors along
FILED = [("p", 2001, 1, 37, None), ("p", 2001, 2, 0, 7), ("p", 2002, 3, 0, None), ("q", 2001, 1, 0, None), ("q", None, 2, 0, None),
         (None, 2001, 1, 37, None), (None, 2001, 2, 0, None)]
EXTRA = [("p", 2001, 4, 0, 20), ("x", 2003, 1, 37, None)]
DELIVERED = [("p", 2001, 1, 5), ("p", 2001, 2, 6), ("p", 2002, 20, 7), ("q", 2001, None, 8), ("q", 2003, 20, 9), (None, 2001, 20, 9)]
FIXES = [("p", 1, "pforms", "add", "3"), ("q", 1, "vforms", "set", "9"), ("zz", 1, "vforms", "set", "9")]


def state_records(spark):
    """All records of two files, a supplement, factors (one incident has two of a year) and corrections."""
    empty = ["cf3", "crf1", "crf2", "crf3", "drf2", "drf3", "drf4"]
    blank = ["accmon", "accday", "spuse", "regowner", "numoccs", "city", "county", "nmforms", "numfatal", "injury", "age", "sex", "repjur", "diedscene"]
    texts = ["crash_dt", "co_char", "y", "x", "investjur", "repag_long", "hispanic", "race_me", "death_dt"]

    def file(rows):
        return spark.createDataFrame(rows, "par string, year int, vnumber int, drf1 int, cf1 int").withColumns({
            "pnumber": F.col("vnumber") * 10, "ptype": F.lit(1), "pforms": F.lit(1), "vforms": F.lit(2),
            **{c: F.lit(None).cast("int") for c in empty}, **{c: F.lit(0) for c in blank}, **{c: F.lit("t") for c in texts}})

    factors = spark.createDataFrame(DELIVERED, "par string, year int, cf1 int, cf2 int")
    rules = spark.createDataFrame(FIXES, "par string, rule int, column_name string, op string, value string")
    return state_person.build([file(FILED[:3]), file(FILED[3:])], factors, file(EXTRA).withColumn("cf2", F.lit(None).cast("int")), rules)


def test_factors_years_supplement_and_corrections(spark, monkeypatch):
    shown = ["incident", "year", "vnum", "pursuit_crash", "pursuit_tag", "vnum_p", "records", "persons", "vehicles"]
    want = sorted(map(repr, [
        ("p", 2001, 1, 0, 1, 1, 6, 4, 2), ("p", 2001, 1, 0, 1, 1, 6, 4, 2), ("p", 2001, 2, 0, 0, 1, 6, 4, 2), ("p", 2001, 2, 0, 0, 1, 6, 4, 2),
        ("p", 2002, 3, 1, 1, 1, 6, 4, 2), ("p", 2001, 4, 1, 1, 1, 6, 4, 2), ("q", 2001, 1, 0, 0, None, 2, 1, 9), ("q", None, 2, 0, 0, None, 2, 1, 9),
        (None, 2001, 1, 0, 1, 1, 2, 1, 2), (None, 2001, 2, 0, 0, 1, 2, 1, 2), ("x", 2003, 1, 0, 1, 1, 1, 1, 2)]))
    assert sorted(repr(tuple(r)) for r in state_records(spark).select(*shown).collect()) == want
    monkeypatch.setattr(rollup, "RANGE_ROWS", 4)  # too large for a task: the joins
    assert sorted(repr(tuple(r)) for r in state_records(spark).select(*shown).collect()) == want


def test_state_records_move_once_for_factors_and_corrections(spark, monkeypatch):
    monkeypatch.setattr(state_person, "stage", lambda df: df)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moves = re.findall(r"Exchange hashpartitioning\((.*), \d+\), (\w+)", plan(state_records(spark)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [by.split("#")[0] for by, why in moves if why.startswith("REPARTITION")] == ["par"]
    # the other exchanges are the factors' one and those of the rules
    assert not [by for by, _ in moves if "year" in by] and len([by for by, _ in moves if by.startswith("__par#")]) == 1
    assert len(moves) == 7


def test_matches_count_for_a_group_and_many_rows_make_many_pieces(spark, monkeypatch):
    df, twice = spark.createDataFrame([(1,)] * 3 + [(2,)], "inc int"), spark.createDataFrame([(1,), (1,), (9,)], "inc int")
    monkeypatch.setattr("incidentlab.ordering.RANGE_ROWS", 1)
    for most, fits in ((6, True), (5, False)):
        monkeypatch.setattr(rollup, "RANGE_ROWS", most)
        assert (rollup.together(df, "inc", twice) is not None) == fits
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(rollup, "RANGE_ROWS", 3)
    many = spark.range(3 * parts + 1).withColumnRenamed("id", "inc")
    assert rollup.together(many, "inc").rdd.getNumPartitions() == parts + 1


def test_linkage_moves_rows_once(spark, monkeypatch):
    left = spark.range(60).select((F.col("id") % 7).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("m"), "id")
    right = left.where("id % 4 > 0")
    once = link.link_full(left, right, ["k", "m"], "id", "id")
    assert plan(once).count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(link, "RANGE_ROWS", 1)
    other = link.link_full(left, right, ["k", "m"], "id", "id")
    assert sorted(map(repr, once.collect())) == sorted(map(repr, other.collect()))


def test_open_and_paired_incidents(spark):
    """Tagged b records without a partner stay, where their incident has a pair; others are pooled."""
    schema = "incident string, county_code int, age int, sex string, record_id string, pursuit_tag int"
    a = spark.createDataFrame([("i", 1, 1, "M", "a1", 1), ("j", 1, 2, "M", "a2", 1), (None, 1, 1, "M", "a3", 1)], schema)
    b = spark.createDataFrame([("i", 1, 1, "M", "b1", 1), ("i", 1, 5, "F", "b2", 1), ("j", 1, 2, "M", "b3", 0), ("j", 1, 9, "M", "b4", 1),
                               (None, 1, 1, "M", "b5", 1), (None, 1, 2, "M", "b6", 1)], schema)
    got = {(r.record_id_a, r.record_id_b, r.status_a, r.status_b) for r in agency_linkage.link_records(a, b).collect()}
    assert got == {("a1", "b1", 2, 2), (None, "b2", 0, 2), ("a2", "b3", 2, 1), (None, "b4", 0, 1), ("a3", "b5", 2, 2), (None, "b6", 0, 2)}
