"""NULL and ordering conventions shared by every module.

Source data is full of gaps, so four conventions differ from plain Spark SQL:
a missing key matches a missing key, a regex test on a missing value is false,
a strict count is missing when any input is missing, and missing values sort last.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_column(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def matches(col: ColumnLike, pattern: str) -> Column:
    """Regex search that is false, never NULL, on a missing value."""
    return F.coalesce(as_column(col).rlike(pattern), F.lit(False))


def if_else_na(cond: Column, yes: Column, no: Column) -> Column:
    """Two-way choice that stays NULL when the condition is unknown."""
    return F.when(cond, yes).when(~cond, no)


def flag(cond: Column) -> Column:
    """0/1 integer that keeps an unknown condition NULL."""
    return cond.cast("int")


def first_match(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """First rule whose condition is true wins; an unknown condition falls through."""
    head, *rest = [(c, v if isinstance(v, Column) else F.lit(v)) for c, v in rules]
    out = reduce(lambda acc, r: acc.when(*r), rest, F.when(*head))
    if default is None:
        return out
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def strict_count(cond: Column) -> Column:
    """Aggregate: rows where ``cond`` holds, NULL if ``cond`` is unknown on any row."""
    return F.when(F.count(cond) == F.count(F.lit(1)), F.count_if(cond))


def level_rank(col: ColumnLike, levels: Sequence[str]) -> Column:
    """1-based position of a category in its level list, NULL outside the list."""
    return first_match([(as_column(col) == v, i) for i, v in enumerate(levels, start=1)])


def known_level(col: ColumnLike, levels: Sequence[str]) -> Column:
    """The category itself, NULL when it is not one of ``levels``."""
    col = as_column(col)
    return F.when(col.isin(*levels), col)


def paste(*cols: ColumnLike, sep: str = "") -> Column:
    """Concatenate as text, writing missing parts as ``NA``."""
    parts = [F.coalesce(as_column(c).cast("string"), F.lit("NA")) for c in cols]
    return F.concat_ws(sep, *parts)


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def natural_join(
    left: DataFrame, right: DataFrame, how: str = "left", expect: Sequence[str] | None = None
) -> DataFrame:
    """Join on every shared column name; ``expect`` pins the key list so that a
    renamed or added column cannot silently change the join."""
    keys = shared_columns(left, right)
    if not keys:
        raise ValueError("the two frames share no column name")
    if expect is not None and set(keys) != set(expect):
        raise ValueError(f"expected join keys {sorted(expect)}, found {sorted(keys)}")
    return null_safe_join(left, right, keys, how)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which NULL matches NULL.

    Spark plans the conjunction as a hash-partitioned equi-join on
    ``(coalesce(k, default), isnull(k))`` pairs. An aggregate on either side is
    therefore exchanged once more (one row per key), which leaves both join inputs
    as plain shuffle stages: the shape adaptive execution can split when a key is hot.
    """
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    joined = left.join(renamed, cond, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("full", "full_outer", "outer", "right", "right_outer"):
        joined = joined.withColumns({k: F.coalesce(F.col(k), F.col(f"__r_{k}")) for k in keys})
    return joined.drop(*[f"__r_{k}" for k in keys])
