"""Counts, shares, crosstabs, completed grids and totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rsem import matches, strict_count


def _count() -> Column:
    return F.count(F.lit(1))


def count_by(df: DataFrame, *dims: str, out: str = "Number") -> DataFrame:
    return df.groupBy(*dims).agg(_count().alias(out))


def grand_total(df: DataFrame, col: str) -> Column:
    """Total of a column over the whole frame, as a one-value subquery."""
    return df.agg(F.sum(col).alias("total")).scalar()


def row_total(df: DataFrame) -> Column:
    """Number of rows of a frame, as a one-value subquery."""
    return df.agg(_count().alias("rows")).scalar()


def with_share(counts: DataFrame, n: str = "Number", out: str = "Percent", base: Column | None = None) -> DataFrame:
    """Share of each count in the total (or in another base)."""
    return counts.withColumn(out, F.col(n) / (grand_total(counts, n) if base is None else base))


def with_total(
    counts: DataFrame, dim: str, measures: Sequence[str], label: str = "Total",
    largest_first: bool = False,
) -> DataFrame:
    """Append a row with the sum of every measure. The counts are small, and the rollup
    produces rows and total from one evaluation of them. ``largest_first`` orders the rows by the
    first measure, descending, then by name, with the total last."""
    key = F.col(dim).cast("string")
    rows = counts.select(key.alias("__dim"), *measures).rollup("__dim").agg(
        F.grouping("__dim").alias("__is_total"), *[F.sum(m).alias(m) for m in measures])
    if largest_first:
        rows = rows.orderBy("__is_total", F.desc(measures[0]), F.asc_nulls_last("__dim"))
    return rows.select(
        F.when(F.col("__is_total") == 1, label).otherwise(F.col("__dim")).alias(dim), *measures)


def percent_text(col: Column, digits: int = 1) -> Column:
    """``0.1234`` -> ``12.3%``."""
    return F.concat(F.format_number(col * 100, digits), F.lit("%"))


def share_table(df: DataFrame, dim: str, digits: int = 1) -> DataFrame:
    """Number and formatted percent per category, the largest first, with a Total row last."""
    counts = with_share(count_by(df, dim))
    return with_total(counts, dim, ["Number", "Percent"], largest_first=True).withColumn(
        "Percent", percent_text(F.col("Percent"), digits)
    )


def breakdown(
    df: DataFrame, dim: str, cat: str, base: Column | None = None, min_total: int = 0
) -> DataFrame:
    """Counts by dimension and category with the dimension's total and its share of
    ``base`` (default: all rows of ``df``, which is the sum of the counts). ``min_total``
    drops small dimensions."""
    counts = count_by(df, dim, cat)
    # One row per category is left for each dimension value.
    total = F.sum("Number").over(Window.partitionBy(dim))
    out = counts.withColumn("Total", total).withColumn(
        "Percent", F.col("Total") / (grand_total(counts, "Number") if base is None else base)
    )
    return out.where(F.col("Total") >= min_total) if min_total else out


def breakdowns(
    df: DataFrame, dims: Sequence[str], cat: str, min_total: int = 0
) -> DataFrame:
    """``breakdown`` by each of several dimensions, from one read of the rows.

    Grouping sets count all dimensions at once: dimension (its name), value (as text), the
    category, Number, Total (of the value) and Percent (of all rows). A missing value is a value of
    its own. ``min_total`` drops small values after the shares are formed."""
    if len(set(dims)) != len(dims) or cat in dims:
        raise ValueError("dimensions must differ from each other and from the category")
    counts = df.select(*dims, cat).groupingSets([[d, cat] for d in dims], *dims, cat).agg(
        _count().alias("Number"), *[F.grouping(d).alias(f"__not_{d}") for d in dims])
    dimension = F.coalesce(*[F.when(F.col(f"__not_{d}") == 0, F.lit(d)) for d in dims])
    # a column that is not grouped by is NULL, so at most one of them has a value
    value = F.coalesce(*[F.col(d).cast("string") for d in dims])
    long = counts.select(dimension.alias("dimension"), value.alias("value"), cat, "Number")
    # One row per category is left for each value of a dimension.
    out = long.withColumn("Total", F.sum("Number").over(Window.partitionBy("dimension", "value")))
    # Every row is in each dimension once.
    base = F.sum("Number").over(Window.partitionBy("dimension"))
    out = out.withColumn("Percent", F.col("Total") / base)
    return out.where(F.col("Total") >= min_total) if min_total else out


def coverage_of(table: DataFrame) -> DataFrame:
    """Sum of the shares still shown after a breakdown dropped small dimensions."""
    return table.agg(F.sum("Percent").alias("coverage"))


def crosstab(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """Wide count table, zero where a combination does not occur."""
    return (
        df.groupBy(row).pivot(col, list(values)).agg(_count()).fillna(0, subset=list(values))
    )


def period_matrix(
    df: DataFrame, key: str, period: str, periods: Sequence[str],
    measures: Mapping[str, tuple[Column, bool]], count_name: str = "fatalities",
    attributes: Mapping[str, str] | None = None, fill_absent: bool = False,
) -> DataFrame:
    """One row per key with every measure in every period and over all periods.

    ``measures`` maps a name to (condition, strict); a strict measure is NULL where the
    condition is unknown for some row. ``attributes`` (name -> column) are fixed to one
    value per key. Cells of a period without rows are NULL unless ``fill_absent``. Totals
    skip NULL cells. Rows are counted per key and period first; only those counts, at most
    one row per period and key, are laid out wide."""
    attributes = attributes or {}
    names = [count_name, *measures]
    # The smallest of strings makes Spark sort what it groups, so rows are counted by the attributes
    # too, in a hash table, and only those counts meet them.
    by = {n: f"__{n}" for n in attributes}
    parts = df.groupBy(key, period, *[F.col(c).alias(by[n]) for n, c in attributes.items()]).agg(
        _count().alias(count_name),
        *[(strict_count(c) if strict else F.count_if(c)).alias(n) for n, (c, strict) in measures.items()],
    )
    counts = parts.groupBy(key, period).agg(
        F.sum(count_name).alias(count_name),
        *[(F.when(F.count(n) == _count(), F.sum(n)) if strict else F.sum(n)).alias(n)
          for n, (_, strict) in measures.items()],
        *[F.min(by[n]).alias(n) for n in attributes],
    )
    wide = counts.groupBy(key).agg(
        *[F.min(n).alias(n) for n in attributes],
        *[F.max(F.when(F.col(period) == p, F.col(n))).alias(f"{n}_{p}") for p in periods for n in names],
        *[F.coalesce(F.sum(F.when(F.col(period).isin(*periods), F.col(n))), F.lit(0)).alias(f"{n}_tot")
          for n in names],
    )
    cells = [f"{n}_{p}" for p in periods for n in names]
    return wide.fillna(0, subset=cells) if fill_absent else wide


def year_span(df: DataFrame, year: str) -> DataFrame:
    """Every year between the first and the last one present."""
    return df.agg(F.min(year).alias("lo"), F.max(year).alias("hi")).where(
        F.col("lo").isNotNull()
    ).select(F.explode(F.sequence("lo", "hi")).alias(year))


def complete_grid(
    counts: DataFrame, axis: DataFrame, dim: str, cat: str, levels: Sequence[str], n: str = "Number"
) -> DataFrame:
    """Counts on the full grid of ``axis`` values x category levels, zero-filled, with the
    total per axis value. ``axis`` is a one-column frame of the values to show."""
    grid = axis.select(dim, F.explode(F.array(*[F.lit(v) for v in levels])).alias(cat))
    # One row per level is left for each axis value.
    return grid.join(counts, [dim, cat], "left").fillna(0, subset=[n]).withColumn(
        "Total", F.sum(n).over(Window.partitionBy(dim))
    )


def coverage(df: DataFrame, ids: Mapping[str, str], by: str) -> DataFrame:
    """Non-missing ids per source (output name -> column), cases and percent per group,
    with a Total row."""
    counts = df.groupBy(F.col(by).cast("string").alias(by)).agg(
        *[F.count(c).alias(n) for n, c in ids.items()], _count().alias("Total_Cases")
    )
    shares = counts.withColumn(
        "Percent", F.bround(F.lit(100) * F.col("Total_Cases") / grand_total(counts, "Total_Cases"), 1)
    )
    return with_total(shares, by, [*ids, "Total_Cases", "Percent"]).withColumn(
        "Percent", F.bround("Percent", 1)
    )


def victim_counts(df: DataFrame, *by: str, levels: Mapping[str, str] | None = None) -> DataFrame:
    """Number per victim group and Total for each group of rows."""
    levels = levels or {"Subjects": "Subject", "Bystanders": "Bystander",
                        "Passengers": "Passenger", "Officers": "Officer"}
    return df.groupBy(*by).agg(
        *[strict_count(F.col("victim") == v).alias(n) for n, v in levels.items()],
        _count().alias("Total"),
    )


def incident_ratio(incidents: DataFrame) -> DataFrame:
    """The share of incidents that are related to a pursuit."""
    related = F.count_if(matches("incident_type", "Pursuit|pursuit"))
    return incidents.agg(F.try_divide(related, _count()).alias("pct_i_p"))


def summary_ratios(deaths: DataFrame) -> DataFrame:
    """The report's headline person ratios in one pass."""
    pursuit = matches("incident_type", "Pursuit|pursuit")
    after = pursuit & matches("incident_type", "After")
    vehicular = pursuit & ~matches("incident_type", "After")
    n = deaths.agg(
        _count().alias("n_all"),
        F.count_if(pursuit).alias("n_p"),
        F.count_if(vehicular).alias("n_pvf"),
        F.count_if(after).alias("n_apf"),
        F.count_if(after & (F.col("cod") == "Gunshot")).alias("n_shot"),
        F.count_if(vehicular & (F.col("victim") == "Subject")).alias("n_subject"),
        F.count_if(vehicular & F.col("victim").isNotNull()).alias("n_victim_known"),
    )
    subject = F.when(F.col("n_victim_known") == F.col("n_pvf"), F.col("n_subject"))
    return n.select(
        F.try_divide("n_p", "n_all").alias("pct_p"),
        F.try_divide("n_pvf", "n_all").alias("pct_pvf"),
        F.try_divide("n_shot", "n_apf").alias("pct_shot_apf"),
        F.try_divide(subject, F.col("n_pvf")).alias("pct_subject_pvf"),
    )
