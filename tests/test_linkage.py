"""Linkage invariants: every record is accounted for once, and hot keys do not multiply."""

from itertools import zip_longest

import pytest
from pyspark.sql import functions as F

from incidentlab import clean, link, ordering
from incidentlab.flows import agency_linkage
from incidentlab.rollup import propagate


def frames(spark):
    left = spark.range(400).select(
        F.col("id").alias("a_id"), F.when(F.col("id") % 4 > 0, F.col("id") % 9).alias("age"), (F.col("id") % 3).alias("p")
    )
    right = spark.range(300).select(
        F.col("id").alias("b_id"), F.when(F.col("id") % 5 > 0, F.col("id") % 12).alias("age"), (F.col("id") % 2).alias("p")
    )
    return left, right


def pairs_by_rank(left, right, keys):
    """Ids of each key in order, paired by position; surplus ids stand alone."""
    out, sides = set(), ({}, {})
    for side, rows, name in zip(sides, (left, right), ("a_id", "b_id")):
        for r in sorted(rows, key=lambda r: r[name]):
            side.setdefault(tuple(r[k] for k in keys), []).append(r[name])
    for key in sides[0].keys() | sides[1].keys():
        a, b = (side.get(key, []) for side in sides)
        out |= set(zip_longest(a, b))
    return out


def test_full_linkage_holds_every_record_once(spark):
    left, right = frames(spark)
    rows = link.link_full(left, right, ["age", "p"], "a_id", "b_id").collect()
    assert sorted(r.a_id_a for r in rows if r.a_id_a is not None) == list(range(400))
    assert sorted(r.b_id_b for r in rows if r.b_id_b is not None) == list(range(300))
    got = {(r.a_id_a, r.b_id_b) for r in rows}
    assert got == pairs_by_rank(left.collect(), right.collect(), ["age", "p"])


def test_first_pairing_is_an_option(spark):
    left, right = frames(spark)
    rows = link.link_full(left, right, ["age", "p"], "a_id", "b_id", pairing="first").collect()
    first = {}
    for r in sorted(right.collect(), key=lambda r: r.b_id):
        first.setdefault((r.age, r.p), r.b_id)
    assert all(r.b_id_b == first.get((r.age, r.p)) for r in rows if r.a_id_a is not None)
    with pytest.raises(ValueError, match="pairing"):
        link.link_full(left, right, ["age"], "a_id", "b_id", pairing="all")


def test_one_key_for_everyone_stays_linear(spark, monkeypatch):
    monkeypatch.setattr(ordering.number_within, "__defaults__", ("row_no", 500))
    left = spark.range(5000).select(F.col("id").alias("a_id"), F.lit(None).cast("int").alias("age"))
    right = spark.range(4000).select(F.col("id").alias("b_id"), F.lit(None).cast("int").alias("age"))
    out = link.link_full(left, right, ["age"], "a_id", "b_id")
    assert {(r.a_id_a, r.b_id_b) for r in out.collect()} == {
        (i, i if i < 4000 else None) for i in range(5000)}
    assert out.count() == 5000


def test_cascade_uses_every_record_once(spark):
    left, right = frames(spark)
    low, high = right.where("b_id < 200"), right.where("b_id >= 200")
    pools = [("one", low, "b_id", ["age", "p"]), ("two", low, "b_id", ["age"]), ("three", high, "b_id", ["age"])]
    rows = link.cascade(left, pools, rest="none", left_id="a_id").collect()
    assert sorted(r.a_id for r in rows) == list(range(400))
    used = [r.match_id for r in rows if r.match_id is not None]
    assert len(used) == len(set(used))
    assert all((r.tier == "none") == (r.match_id is None) for r in rows)
    one = {(r.a_id, int(r.match_id)) for r in rows if r.tier == "one"}
    want = pairs_by_rank(left.collect(), low.collect(), ["age", "p"])
    assert one == {p for p in want if None not in p}
    rest = [r for r in left.collect() if r.a_id not in {a for a, _ in one}]
    pool = [r for r in low.collect() if r.b_id not in {b for _, b in one}]
    two = {(r.a_id, int(r.match_id)) for r in rows if r.tier == "two"}
    assert two == {p for p in pairs_by_rank(rest, pool, ["age"]) if None not in p}


def test_presence_join_pairs_or_refuses_repeated_keys(spark):
    left = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "y")], "l int, k string")
    right = spark.createDataFrame([(7, "x"), (8, "x"), (9, "x"), (10, None)], "r int, kk string")
    rows = link.join_presence(left, right, {"k": "kk"}, "there", ("l", "r")).collect()
    assert {(r.l, r.r, r.k, r.there) for r in rows} == {
        (1, 7, "x", 1), (2, 8, "x", 1), (None, 9, "x", 1), (3, 10, None, 1), (4, None, "y", 0)}
    with pytest.raises(Exception, match="repeats a key"):
        link.join_presence(left, right, {"k": "kk"}, "there").collect()
    once = right.where("r <> 8 AND r <> 9")
    with pytest.raises(Exception, match="repeats a key"):  # on the left side, too
        link.join_presence(left, once, {"k": "kk"}, "there").collect()
    rows = link.join_presence(left.where("l <> 2"), once, {"k": "kk"}, "there").collect()
    assert {(r.l, r.r, r.there) for r in rows} == {(1, 7, 1), (3, 10, 1), (4, None, 0)}
    with pytest.raises(Exception, match="repeats a key"):  # also where only the marker is read
        link.join_presence(left, once, {"k": "kk"}, "there").agg(F.sum("there")).collect()


def test_consecutive_tiers_on_one_key_are_one_step(spark):
    """Pools of one step behind each other give what separate steps give."""
    left, right = frames(spark)
    low, high = right.where("b_id < 200"), right.where("b_id >= 200")
    tiers = [("low", low, "b_id", ["age"]), ("again", low, "b_id", ["age"]), ("high", high, "b_id", ["age"])]
    out = link.cascade(left, tiers, rest="none", left_id="a_id")
    rows = {r.a_id: (r.tier, r.match_id and int(r.match_id)) for r in out.collect()}
    first = {a: b for a, b in pairs_by_rank(left.collect(), low.collect(), ["age"]) if None not in (a, b)}
    rest = [r for r in left.collect() if r.a_id not in first]
    then = {a: b for a, b in pairs_by_rank(rest, high.collect(), ["age"]) if None not in (a, b)}
    want = {a: ("low", b) for a, b in first.items()} | {a: ("high", b) for a, b in then.items()}
    assert rows == {r.a_id: want.get(r.a_id, ("none", None)) for r in left.collect()}
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text  # one step was run and written; nothing is moved behind it


def test_repeated_lookup_codes_do_not_multiply_rows(spark):
    df = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id int, code int")
    lookup = spark.createDataFrame([(5, "b"), (5, "a"), (7, "c")], "c int, label string")
    assert {(r.id, r.name) for r in clean.recode(df, "code", lookup, "c", "label", "name").collect()} == {
        (1, "a"), (2, None), (3, None)}
    coded = spark.createDataFrame([(1, 9), (1, 8)], "id int, final int")
    assert {(r.id, r.code) for r in clean.overlay(df, coded, "id", {"code": "final"}).collect()} == {
        (1, 8), (2, 6), (3, None)}


def test_several_pursued_vehicles_do_not_multiply_records(spark):
    rows = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "incident int, rec int")
    sides = [f"{c}_{s}" for c in [*agency_linkage.PREFERRED, *agency_linkage.LARGEST] for s in "ab"]
    rows = rows.withColumns({c: F.lit(None).cast("date" if c.startswith("date") else "int") for c in sides})
    rows = rows.withColumns({f"record_id_{s}": F.lit("x") for s in "ab"})
    units = spark.createDataFrame([(1, 4), (1, 3)], "incident int, vnum_p int")
    out = agency_linkage.consensus(rows, units).collect()
    assert {(r.rec, r.vnum_p_w) for r in out} == {(10, 3), (11, 3), (12, None)} and len(out) == 3


def test_several_flagged_units_do_not_multiply_rows(spark):
    df = spark.createDataFrame(
        [(1, 1, 1), (1, 2, 1), (1, 3, 0), (2, 1, 0), (None, 4, 1)], "inc int, unit int, flag int"
    )
    got = {(r.inc, r.unit): (r.flagged_unit, r.flagged_units, r.in_flagged_unit)
           for r in propagate(df, "inc", F.col("flag") == 1, "unit").collect()}
    assert got == {(1, 1): (1, 2, 1), (1, 2): (1, 2, 1), (1, 3): (1, 2, 0), (2, 1): (None, 0, 0), (None, 4): (4, 1, 1)}
