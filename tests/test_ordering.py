"""Numbering is exact when one group or one date holds most of the rows."""

import pytest
from pyspark.sql import functions as F

from incidentlab import ordering
from incidentlab.ordering import keep_first, number_global, number_within


@pytest.fixture(scope="module")
def skewed(spark):
    """9000 rows; one key holds 6000 of them, one key is missing, dates repeat."""
    df = spark.range(9000, numPartitions=6).select(
        F.col("id"),
        F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 5 > 0, F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("k"),
        F.when(F.col("id") % 7 > 0, F.col("id") % 4).alias("day"),
    )
    return df


def expected(rows, key):
    def order(r):
        return (r["day"] is None, r["day"] or 0, r["id"])

    out, seen = {}, {}
    for r in sorted(rows, key=order):
        seen[key(r)] = seen.get(key(r), 0) + 1
        out[r["id"]] = seen[key(r)]
    return out


@pytest.mark.parametrize("largest", [1_000_000, 1000, 10])
def test_within_equals_brute_force(skewed, largest):
    out = number_within(skewed, ["k"], ["day", "id"], largest=largest)
    got = {r.id: r.row_no for r in out.collect()}
    assert got == expected(skewed.collect(), lambda r: r["k"])


@pytest.mark.parametrize("rows", [1_000_000, 700])
def test_global_equals_brute_force(skewed, monkeypatch, rows):
    monkeypatch.setattr(ordering, "RANGE_ROWS", rows)
    got = {r.id: r.row_no for r in number_global(skewed, ["day", "id"], start=101).collect()}
    want = expected(skewed.collect(), lambda r: 0)
    assert got == {i: n + 100 for i, n in want.items()}


def test_the_hot_group_is_split(skewed):
    ranged = ordering._ranged(skewed, [F.col("k"), F.col("day"), F.col("id")], 8)
    sizes = [r["count"] for r in ranged.where("k = 'hot'").groupBy("__range").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 3000


def test_more_rows_give_more_ranges():
    counts = [ordering.range_count(n) for n in (0, 1, 10**5, 10**7, 10**9, 10**12)]
    assert counts == sorted(counts) and counts[0] == 1
    assert counts[-1] == 10**12 // ordering.RANGE_ROWS


def test_ties_are_an_error(skewed):
    for out in (number_global(skewed, ["day"]), number_within(skewed, ["k"], ["day"]),
                number_within(skewed, ["k"], ["day"], largest=10)):
        with pytest.raises(Exception, match="unique key"):
            out.collect()


def test_small_and_empty_inputs(spark, skewed):
    one = skewed.limit(1)
    assert [r.row_no for r in number_global(one, ["id"]).collect()] == [1]
    none = skewed.where("id < 0")
    assert number_global(none, ["id"]).count() == 0
    assert number_within(none, ["k"], ["id"]).count() == 0


def test_first_rows_are_cut_before_the_shuffle(skewed):
    plan = keep_first(skewed, ["k"], ["id"], 2)._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan
    assert keep_first(skewed, ["k"], ["id"], 2).where("k = 'hot'").count() == 2
