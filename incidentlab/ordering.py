"""Exact row numbers over groups of any size.

``row_number()`` over a whole table, or over a group that holds a third of it, is one task sorting
all of those rows. Here Spark deals such rows out by ranges of the sort order, numbers them inside
each range while it writes the ranges down, and every range is then shifted by the number of rows
before it. The number of ranges follows the number of rows.

Every ordering must end in a unique key: numbers would be arbitrary among ties, so a repeated order
key is an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .io import stage
from .rsem import ColumnLike, as_column, null_safe_join

#: Rows that one task sorts. A group up to this size is numbered in one piece.
RANGE_ROWS = 1_000_000
#: Below that, a few ranges keep several cores busy.
LEAST_RANGE_ROWS, FEW_RANGES = 20_000, 8
_INSIDE = (1 << 33) - 1  # monotonically_increasing_id: partition above, row of it below
_TIES = "the order of the numbering does not end in a unique key"


def range_count(rows: int) -> int:
    return max(1, -(-rows // RANGE_ROWS), min(FEW_RANGES, -(-rows // LEAST_RANGE_ROWS)))


def _window_order(order: Sequence[Column]) -> list[Column]:
    return [c.asc_nulls_last() for c in order]


def _ranged(df: DataFrame, order: Sequence[Column], ranges: int | None = None) -> DataFrame:
    """The rows, written down in ranges of the order, with ``__range``, the place in it, and whether
    another row has the same key. Equal keys are in one range, so ties are seen there, and no row is
    moved again for it."""
    by = _window_order(order)
    dealt = df.repartitionByRange(ranges or range_count(df.count()), *by)
    tied = F.count(F.lit(1)).over(Window.partitionBy(*order)) > 1
    placed = dealt.withColumn("__tied", tied).sortWithinPartitions(*by).withColumn(
        "__at", F.monotonically_increasing_id())
    return stage(placed).withColumns({
        "__range": F.shiftright("__at", 33), "__place": F.col("__at").bitwiseAND(F.lit(_INSIDE)),
    }).drop("__at")


def _untied(value: Column, tied: Column) -> Column:
    return F.when(tied, F.raise_error(F.lit(_TIES)).cast("long")).otherwise(value)


def number_global(
    df: DataFrame, order: Sequence[ColumnLike], out: str = "row_no", start: int = 1
) -> DataFrame:
    """Number all rows ``start, start+1, ...`` in ``order`` (ascending, missing last; negate a
    rank for descending). The rows are written down once, in order, when this is called."""
    order = [as_column(c) for c in order]
    ranged = _ranged(df, order)
    # One row per range reaches this window.
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("__range").agg(
        F.count(F.lit(1)).alias("__rows"), F.max("__tied").alias("__ties"))
    offsets = counts.select("__range", _untied(
        F.coalesce(F.sum("__rows").over(before), F.lit(0)), F.col("__ties")).alias("__before"))
    return ranged.join(offsets, "__range").withColumn(
        out, F.col("__before") + F.col("__place") + start
    ).drop("__range", "__place", "__before", "__tied")


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group, at least if they are more than ``RANGE_ROWS``. Counted when this is
    called, so hand over a stored table."""
    return group_sizes(df, keys)[1]


def group_sizes(
    df: DataFrame, keys: Sequence[str], matched: DataFrame | None = None
) -> tuple[int, int]:
    """All rows, and those of the largest group as in ``largest_group``. With ``matched``, a table with
    the same keys, every row of a group counts once for each match there."""
    rows = df.count()  # of a stored table only footers are read
    most = rows if matched is None else rows * max(1, matched.count())  # no group can be larger
    if most <= RANGE_ROWS:
        return rows, most
    one, none = F.lit(1), F.lit(0)
    sides = df.select(*keys, one.alias("__rows"), none.alias("__matches"))
    if matched is not None:
        sides = sides.unionByName(matched.select(*keys, none.alias("__rows"), one.alias("__matches")))
    sizes = sides.groupBy(*keys).agg(F.sum("__rows").alias("__rows"), F.sum("__matches").alias("__matches"))
    return rows, sizes.agg(F.max(F.col("__rows") * F.greatest("__matches", one))).first()[0]


def number_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[ColumnLike], out: str = "row_no"
) -> DataFrame:
    """Plain numbering; each group is one task's."""
    order = [as_column(c) for c in order]
    inside = Window.partitionBy(*keys).orderBy(*_window_order(order))
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    tied = F.lag(key).over(inside).eqNullSafe(key)
    return df.withColumn(out, _untied(F.row_number().over(inside).cast("long"), tied))


def number_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[ColumnLike], out: str = "row_no",
    largest: int = RANGE_ROWS,
) -> DataFrame:
    """Number rows 1, 2, ... inside each key group, in ``order``.

    Groups of up to ``largest`` rows are numbered in one piece each. The rows of larger groups are
    written down in ranges over (keys, order); a range's share of a group is shifted by the group's
    rows in earlier ranges. Group sizes are counted when this is called, so hand over a stored
    table rather than a pipeline."""
    order = [as_column(c) for c in order]
    if df.count() <= largest:  # no group can be larger; of a stored table only footers are read
        return number_groups(df, keys, order, out)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    large = stage(sizes.where(F.col("__rows") > largest))
    rows = large.agg(F.sum("__rows")).first()[0]
    if rows is None:
        return number_groups(df, keys, order, out)
    large = large.select(*keys)
    rest = number_groups(null_safe_join(df, large, keys, "left_anti"), keys, order, out)
    ranged = _ranged(null_safe_join(df, large, keys, "left_semi"), [*map(F.col, keys), *order],
                     max(range_count(rows), -(-rows // largest)))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shares = ranged.groupBy(*keys, "__range").agg(
        F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__n"),
        F.max("__tied").alias("__ties"))
    shift = F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1
    shares = shares.select(*keys, "__range", _untied(shift, F.col("__ties")).alias("__shift"))
    numbered = null_safe_join(ranged, shares, [*keys, "__range"], "left").withColumn(
        out, F.col("__place") + F.col("__shift"))
    return rest.unionByName(numbered.select(*rest.columns))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[ColumnLike], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key group.

    Spark applies a rank filter of this form before the shuffle as well as after it
    (``WindowGroupLimit``), so at most ``n`` rows per key leave each map task."""
    w = Window.partitionBy(*keys).orderBy(*_window_order([as_column(c) for c in order]))
    kept = df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n)
    return kept.drop("__rank")
