"""Lists packed into one text column: several agencies on one case."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import AGENCY_ABBREVIATIONS
from .rsem import ColumnLike, as_column, first_match, if_else_na, matches


def explode_members(
    df: DataFrame, col: str = "agency", sep: str = ", ", position: str | None = "seq"
) -> DataFrame:
    """One row per listed member (blank members dropped), with its 1-based position."""
    at = position or "__seq"
    others = [c for c in df.columns if c != col]
    long = df.select(*others, F.posexplode(F.split(col, sep)).alias("__pos", col)).where(
        F.col(col) != ""
    )
    keep = [*others, (F.col("__pos") + 1).alias(at), col] if position else [*others, col]
    return long.select(*keep)


def widen_members(
    df: DataFrame, col: str = "agency", sep: str = ", ", n: int | None = None
) -> DataFrame:
    """Columns ``<col>1 .. <col>n``; an empty string where the list is shorter.

    The width is that of the longest list, which is looked up when this is called. A list longer
    than a given ``n`` is an error: no member is dropped."""
    parts = F.split(col, sep)
    if n is None:
        n = df.agg(F.max(F.size(parts))).first()[0]
        n = max(1, n or 1)
    size = F.coalesce(F.size(parts), F.lit(0))
    whole = F.when(size > n, F.raise_error(F.concat(
        F.lit(f"a list in {col} has more than {n} members: "), size.cast("string"))).cast("string"))
    return df.withColumns({
        f"{col}{i + 1}": F.coalesce(whole, F.get(parts, F.lit(i)), F.lit("")) for i in range(n)
    })


def narrow_members(df: DataFrame, ids: Sequence[str], cols: Sequence[str], out: str = "agency") -> DataFrame:
    """Wide member columns back to one row per non-blank member."""
    return df.unpivot(list(ids), list(cols), "seq", out).where(F.col(out) != "")


def member_type(name: ColumnLike = "agency") -> Column:
    """Agency type read off a single agency's name; the order of the tests matters."""
    # The tests below and their order decide the result.
    return first_match(
        [
            (matches(name, "Police"), "Local PD"),
            (matches(name, "Tribal"), "Tribal PD"),
            (matches(name, "Sherif"), "County SO"),
            (matches(name, "County"), "Other County"),
            (matches(name, "Correc"), "Corrections"),
            (matches(name, "Patrol"), "WSP"),
            (matches(name, "Fed|US"), "Federal"),
        ],
        "Other",
    )


def retype_members(df: DataFrame, col: str = "agency", kind: str = "agency_type") -> DataFrame:
    """Give each exploded member its own type where the case was typed as "Multiple"."""
    multiple = matches(kind, "Multiple")
    return df.withColumn(kind, if_else_na(multiple, member_type(col), F.col(kind)))


def abbreviate(
    col: ColumnLike, pairs: Sequence[tuple[str, str]] = AGENCY_ABBREVIATIONS
) -> Column:
    """Shorten agency names by literal replacement, in the given order."""
    out = as_column(col)
    for long, short in pairs:
        out = F.replace(out, F.lit(long), F.lit(short))
    return out


def collapse_multiple(col: ColumnLike, label: str = "Multiple agencies") -> Column:
    """Name of the single agency, or one label for a list of several."""
    return F.when(matches(col, ","), label).otherwise(as_column(col))
