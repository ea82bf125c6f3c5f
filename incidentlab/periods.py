"""Policy periods, equal-length comparison windows and rates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .clean import period_of
from .rsem import ColumnLike, as_column, first_match, strict_count


@dataclass(frozen=True)
class Policy:
    """Boundary dates. ``as_of`` is the report date and is always given by the caller."""

    start: date
    reform: date
    rollback: date
    as_of: date

    @property
    def days(self) -> dict[str, int]:
        return {
            "pre": (self.reform - self.start).days,
            "reform": (self.rollback - self.reform).days,
            "rollback": (self.as_of - self.rollback).days,
        }

    @property
    def bounds(self) -> list[tuple[str, date | None, date | None]]:
        return [
            ("pre", None, self.reform),
            ("reform", self.reform, self.rollback),
            ("rollback", self.rollback, None),
        ]

    @property
    def pre_reform_window(self) -> date:
        return self.reform - timedelta(days=self.days["reform"])

    @property
    def pre_rollback_window(self) -> date:
        return self.rollback - timedelta(days=self.days["rollback"])


def period_lengths(
    df: DataFrame, day: str, start: date, reform: date, rollback: date, as_of: date | None = None
) -> DataFrame:
    """Length of each period in days and years and the start of its lookback window, one
    row per period. Without ``as_of`` the last period ends at the newest record."""
    end = F.max(day) if as_of is None else F.lit(as_of)
    edges = df.agg(end.cast("date").alias("as_of")).select(
        F.explode(F.array(
            F.struct(F.lit("pre").alias("period"), F.lit(start).alias("from_date"), F.lit(reform).alias("to_date")),
            F.struct(F.lit("reform").alias("period"), F.lit(reform).alias("from_date"), F.lit(rollback).alias("to_date")),
            F.struct(F.lit("rollback").alias("period"), F.lit(rollback).alias("from_date"), F.col("as_of").alias("to_date")),
        )).alias("e")
    ).select("e.*")
    days = F.datediff("to_date", "from_date")
    return edges.withColumns({
        "days": days,
        "years": F.round(days / 365, 6),
        "lookback_start": F.date_sub("from_date", days),
    })


def label_from_table(
    df: DataFrame, day: str, periods: DataFrame, out: str = "period", overlap: str = "fail",
    bucket_days: int = 32, horizon: tuple[date, date] = (date(1900, 1, 1), date(2100, 1, 1)),
) -> DataFrame:
    """Label every row by a table of periods (``period``, ``from_date``, ``to_date``, half open), of
    any number of rows.

    Days and periods are cut into buckets of ``bucket_days`` days and meet by the bucket, so that
    only the few periods that touch it are compared with a day; there is no nested loop and no
    list of literals. A missing bound is that of ``horizon``. Where periods overlap, that is an
    error (``overlap="fail"``), or a period ends where a later one begins (``"later"``; of periods
    with one beginning, the one with the greater label counts). Days in no period, missing days
    and days outside the horizon have no label; empty periods (``to_date`` not after ``from_date``)
    hold no day. Rows are never multiplied or lost."""
    if overlap not in ("fail", "later"):
        raise ValueError(f"unknown way to settle overlaps {overlap!r}")
    low, high = (F.lit(d) for d in horizon)

    def bucket(d: Column) -> Column:
        return F.floor(F.datediff(d, low) / bucket_days)

    bounds = periods.select(
        F.col("period").alias("__label"),
        F.greatest(F.coalesce("from_date", low), low).alias("__from"),
        F.least(F.coalesce("to_date", high), high).alias("__to"),
    ).where(F.col("__from") < F.col("__to"))
    cut = bounds.withColumn("__bucket", F.explode(F.sequence(
        bucket(F.col("__from")), bucket(F.date_sub("__to", 1)))))
    # Periods that overlap share the bucket in which the later one begins. One bucket's periods
    # are a window's rows.
    later = F.lead("__from").over(Window.partitionBy("__bucket").orderBy("__from", "__label"))
    overlaps = later < F.col("__to")
    if overlap == "fail":
        end = F.when(overlaps, F.raise_error(F.lit("periods overlap")).cast("date")).otherwise(
            F.col("__to"))
    else:
        end = F.least("__to", later)
    pieces = cut.withColumn("__to", end)
    rows = df.withColumn("__bucket", bucket(F.col(day)))
    inside = (rows["__bucket"] == pieces["__bucket"]) & (F.col("__from") <= F.col(day)) & (
        F.col(day) < F.col("__to"))
    return rows.join(pieces, inside, "left").select(
        *df.columns, F.col("__label").alias(out))


def _window(
    day: str, boundary: date, length: int, end: date | None, inclusive: bool
) -> Column:
    """Days within reach of a boundary. The side before starts strictly after
    ``boundary - length`` days, which makes it one day short of the side after;
    ``inclusive`` starts it on that day. ``end`` is the first day no longer counted."""
    lower = F.lit(boundary - timedelta(days=length))
    inside = (F.col(day) >= lower) if inclusive else (F.col(day) > lower)
    return inside if end is None else inside & (F.col(day) < F.lit(end))


def compare_windows(
    df: DataFrame, day: str, boundary: date, length: int, end: date | None, by: str,
    levels: Sequence[str], sides: tuple[str, str] = ("before", "after"), inclusive: bool = False,
) -> DataFrame:
    """Counts per category on both sides of a boundary: side, one column per level (NULL
    if a category is unknown on that side), Total."""
    side = F.when(F.col(day) < F.lit(boundary), sides[0]).otherwise(sides[1])
    return df.where(_window(day, boundary, length, end, inclusive)).groupBy(side.alias("side")).agg(
        *[strict_count(F.col(by) == v).alias(v) for v in levels],
        F.count(F.lit(1)).alias("Total"),
    )


def pct_change(
    df: DataFrame, day: str, boundary: date, length: int, end: date | None = None,
    inclusive: bool = False,
) -> DataFrame:
    """One row: number before, number after, and relative change (NULL when the side
    before is empty)."""
    counts = df.where(_window(day, boundary, length, end, inclusive)).agg(
        F.count_if(F.col(day) < F.lit(boundary)).alias("n_before"),
        F.count_if(F.col(day) >= F.lit(boundary)).alias("n_after"),
    )
    return counts.withColumn("pct_change", F.try_divide("n_after", "n_before") - 1)


def pct_changes(
    df: DataFrame, day: str, windows: Mapping[str, tuple[date, int, date | None]],
    inclusive: bool = False,
) -> DataFrame:
    """``pct_change`` for several boundaries (label -> boundary, length, end) from one pass over
    the rows: boundary, n_before, n_after, pct_change."""
    counts = {}
    for label, (boundary, length, end) in windows.items():
        inside = _window(day, boundary, length, end, inclusive)
        counts[f"{label}__before"] = F.count_if(inside & (F.col(day) < F.lit(boundary)))
        counts[f"{label}__after"] = F.count_if(inside & (F.col(day) >= F.lit(boundary)))
    rows = F.array(*[
        F.struct(F.lit(label).alias("boundary"), F.col(f"{label}__before").alias("n_before"),
                 F.col(f"{label}__after").alias("n_after")) for label in windows])
    wide = df.agg(*[c.alias(n) for n, c in counts.items()])
    long = wide.select(F.explode(rows).alias("e")).select("e.*")
    return long.withColumn("pct_change", F.try_divide("n_after", "n_before") - 1)


def month_spine(spark: SparkSession, start: date, end: date) -> DataFrame:
    """Every month from ``start`` to ``end``: year, mon (Jan..Dec), mon_yr, index_date."""
    months = spark.range(1).select(
        F.explode(F.sequence(
            F.trunc(F.lit(start), "month"), F.trunc(F.lit(end), "month"), F.expr("interval 1 month")
        )).alias("index_date")
    )
    mon = F.date_format("index_date", "MMM")
    return months.select(
        F.year("index_date").alias("year"),
        mon.alias("mon"),
        F.concat_ws(".", mon, F.year("index_date")).alias("mon_yr"),
        "index_date",
    )


def monthly_counts(df: DataFrame, day: str, policy: Policy) -> DataFrame:
    """The month spine with the number of rows per month (NULL if none) and the policy
    period in force on the first of the month."""
    counts = df.groupBy(F.trunc(day, "month").alias("index_date")).agg(
        F.count(F.lit(1)).alias("num")
    )
    spine = month_spine(df.sparkSession, policy.start, policy.as_of)
    return spine.join(counts, "index_date", "left").withColumn(
        "policy_period", period_of("index_date", policy.bounds)
    )


def annualized(df: DataFrame, policy: Policy, num: str = "num") -> DataFrame:
    """Monthly counts to one row per period with monthly and annual rates. Months are
    30-day months; halves round to even."""
    months = first_match(
        [(F.col("policy_period") == p, F.bround(F.lit(d / 30), 1)) for p, d in policy.days.items()]
    )
    per_period = df.groupBy("policy_period").agg(
        F.coalesce(F.sum(num), F.lit(0)).alias("fatalities")
    )
    return (
        per_period.withColumn("months", months)
        .withColumn("monthly_rate", F.bround(F.try_divide("fatalities", "months"), 2))
        .withColumn("annualized_rate", F.bround(F.col("monthly_rate") * 12, 1))
    )


def fiscal_year(day: ColumnLike, start_month: int = 8) -> Column:
    """Year in which the fiscal year holding ``day`` began (August start by default)."""
    return F.year(F.add_months(as_column(day), -(start_month - 1)))


def fiscal_label(day: ColumnLike, start_month: int = 8) -> Column:
    """Label such as ``Aug2015-Jul2016``."""
    first = fiscal_year(day, start_month)
    begin = F.date_format(F.make_date(first, F.lit(start_month), F.lit(1)), "MMM")
    finish = F.date_format(
        F.add_months(F.make_date(first, F.lit(start_month), F.lit(1)), 11), "MMM"
    )
    return F.concat(begin, first, F.lit("-"), finish, first + 1)
