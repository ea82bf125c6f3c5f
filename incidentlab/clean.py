"""Classification, recoding, corrections and exclusions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rsem import ColumnLike, as_column, first_match, matches, null_safe_join


def classify(
    df: DataFrame, out: str, rules: Sequence[tuple[Column, object]], default: object = None
) -> DataFrame:
    """Add ``out`` from an ordered rule list; the first true rule wins."""
    return df.withColumn(out, first_match(rules, default))


def any_code(cols: Sequence[ColumnLike], *codes: object) -> Column:
    """1 if any column equals one of the codes, 0 if none does, NULL if that is unknown."""
    hits = [as_column(c) == F.lit(code) for c in cols for code in codes]
    return reduce(lambda a, b: a | b, hits).cast("int")


def any_match(cols: Sequence[ColumnLike], pattern: str) -> Column:
    """1 if any text column matches; a missing text does not match."""
    return reduce(lambda a, b: a | b, [matches(c, pattern) for c in cols]).cast("int")


def tag_text(
    df: DataFrame, col: str, patterns: Sequence[tuple[str, object]], out: str = "tag",
    default: object = None, ignore_case: bool = False,
) -> DataFrame:
    """Tag free text by the first pattern found anywhere in it."""
    text = F.lower(col) if ignore_case else F.col(col)
    return df.withColumn(out, first_match([(matches(text, p), v) for p, v in patterns], default))


def recode_values(col: ColumnLike, values: Mapping[object, object]) -> Column:
    """Replace listed values, keep all others. For a handful of literal repairs."""
    col = as_column(col)
    return first_match([(col == F.lit(k), v) for k, v in values.items()], col)


def recode(
    df: DataFrame, col: str, lookup: DataFrame, code: str, label: str, out: str,
    keep_unmatched: bool = False,
) -> DataFrame:
    """Replace a code by its label from a lookup table; optionally keep unmatched codes. A code
    listed several times has its smallest label, so rows are never multiplied.

    Whether the lookup is broadcast is left to Spark's size threshold, so a large
    code table falls back to a shuffled join."""
    table = lookup.groupBy(F.col(code).alias(col)).agg(F.min(label).alias("__label"))
    joined = df.join(table, col, "left")
    value = F.col("__label")
    if keep_unmatched:
        value = F.coalesce(value, F.col(col).cast(lookup.schema[label].dataType))
    return joined.withColumn(out, value).drop("__label").select(
        *df.columns, *([] if out in df.columns else [out])
    )


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.fillna(0, subset=list(cols))


def apply_fixes(
    df: DataFrame, fixes: DataFrame, key: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Overwrite single cells. ``fixes`` has (key, column_name, new_value as text). Of several
    values for one cell the smallest text is used; a missing value leaves the cell as it is.
    ``columns`` names the columns that fixes may touch (default: all), which keeps the plan short."""
    named = [c for c in columns or df.columns if c != key]
    types = dict(df.dtypes)
    per_key = fixes.groupBy(key).agg(
        *[
            F.min(F.when(F.col("column_name") == c, F.col("new_value"))).alias(f"__fix_{c}")
            for c in named
        ]
    )
    fixed = df.join(per_key, key, "left").withColumns(
        {c: F.coalesce(F.col(f"__fix_{c}").try_cast(types[c]), F.col(c)) for c in named}
    )
    return fixed.select(*df.columns)


def exclude(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Drop the rows whose key appears in ``keys`` (all of its columns)."""
    return null_safe_join(df, keys.distinct(), keys.columns, "left_anti")


def overlay(df: DataFrame, coded: DataFrame, key: str, cols: Mapping[str, str]) -> DataFrame:
    """Manual coding on top of a draft: ``cols`` maps draft column -> final column in
    ``coded``; the final value wins where present. Of several codings of one key the smallest
    value of each column is used."""
    finals = coded.groupBy(key).agg(*[F.min(f).alias(f"__final_{d}") for d, f in cols.items()])
    joined = df.join(finals, key, "left").withColumns(
        {d: F.coalesce(F.col(f"__final_{d}"), F.col(d)) for d in cols}
    )
    return joined.select(*df.columns)


def period_of(
    day: ColumnLike, bounds: Sequence[tuple[str, date | None, date | None]]
) -> Column:
    """Label of the half-open interval [from, to) that holds the day."""
    day = as_column(day)
    rules = []
    for label, start, end in bounds:
        cond = F.lit(True)
        if start is not None:
            cond = cond & (day >= F.lit(start))
        if end is not None:
            cond = cond & (day < F.lit(end))
        rules.append((cond & day.isNotNull(), label))
    return first_match(rules)


def label_period(
    df: DataFrame, day: str, bounds: Sequence[tuple[str, date | None, date | None]],
    out: str = "policy_period", dummies: Sequence[str] = (),
) -> DataFrame:
    """Add the period label and, for each label in ``dummies``, a 0/1 column."""
    df = df.withColumn(out, period_of(day, bounds))
    return df.withColumns({f"{p}_period": (F.col(out) == p).cast("int") for p in dummies})
