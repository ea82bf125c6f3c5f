"""Corrections of single cells: rules with several optional conditions, operations and an order.

A rule names an incident, any further conditions (a record, a unit or one of several, an age), a
column, and what happens to it: ``set`` to a value, ``add`` a number (counts found too low during
linkage), or ``missing``. Rules are brought together into one list per incident, which meets the
records in one join; a record then takes the rules of its incident that it satisfies, in order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rsem import null_safe_join

SET, ADD, MISSING = "set", "add", "missing"
#: Hand-made rules of one incident; more of them are taken for a mistake in the table.
MOST_RULES = 10_000


def _allowed(rules: DataFrame, condition: str) -> Column:
    """The values that a condition admits, as a list of texts; NULL admits any."""
    if condition not in rules.columns:
        return F.lit(None).cast("array<string>")
    if isinstance(rules.schema[condition].dataType, T.ArrayType):
        return F.col(condition).cast("array<string>")
    text = F.col(condition).cast("string")
    return F.when(text.isNotNull(), F.array(text))


def rules_per_key(rules: DataFrame, key: str, conditions: Sequence[str]) -> DataFrame:
    """One row per key: its rules in order. Two rules of a key with one number for one column, an
    unknown operation, a set or add without a value, and a rule without a key are errors."""
    lacking = F.raise_error(F.lit("a rule lacks its key, number, value or a known operation"))
    # Part of the key itself: a join by it would leave out rules without one, unseen.
    rules = rules.withColumn(key, F.coalesce(F.col(key), lacking.cast(rules.schema[key].dataType)))
    known = F.col("op").isin(SET, ADD, MISSING) & F.col("rule").isNotNull()
    valued = (F.col("op") == MISSING) | F.col("value").isNotNull()
    checked = F.when(known & valued, F.col("op")).otherwise(lacking)
    entry = F.struct(
        F.col("rule").cast("long").alias("rule"), "column_name", checked.alias("op"),
        F.col("value").cast("string").alias("value"),
        *[_allowed(rules, c).alias(f"if_{c}") for c in conditions])
    # Counted before any list is made: a key with rules without end is an error, not a list that
    # outgrows its task.
    counts = rules.groupBy(key, "column_name", "rule").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.groupBy(key).agg(F.sum("n").alias("__n"), F.max("n").alias("__same"))
    wrong = (F.col("__n") > MOST_RULES) | (F.col("__same") > 1)
    checked = null_safe_join(rules.select(key, entry.alias("__rule")), counts, [key], "left")
    error = F.raise_error(F.lit(
        "two rules of a key have one number for one column, or a key has too many rules"))
    rule = F.when(wrong, error.cast(checked.schema["__rule"].dataType)).otherwise(F.col("__rule"))
    return checked.groupBy(key).agg(F.array_sort(F.collect_list(rule)).alias("__rules"))


def _holds(rule: Column, conditions: Mapping[str, Column]) -> Column:
    def admitted(c: str) -> Column:
        listed = rule[f"if_{c}"]
        inside = F.array_contains(listed, conditions[c].cast("string"))
        return listed.isNull() | F.coalesce(inside, F.lit(False))

    return reduce(lambda a, b: a & b, [admitted(c) for c in conditions], F.lit(True))


def correct(
    df: DataFrame, rules: DataFrame, key: str, columns: Sequence[str],
    conditions: Sequence[str] | Mapping[str, Column] = (), conflicts: str = "apply",
) -> DataFrame:
    """Apply ``rules`` (``key``, ``rule`` (its number), ``column_name``, ``op``, ``value`` as text,
    and any of ``conditions``) to the cells of ``columns``.

    A condition is a column of ``df``, or a name with what it stands for; a rule holds for a record whose value is the rule's one, or in
    the rule's list, and a NULL in the rule admits every record. A missing value of a record
    satisfies no condition. Rules see the values before any correction, and are applied in the
    order of their numbers: an ``add`` after a ``set`` adds to the new value, an ``add`` to a missing
    cell leaves it missing, and a value that is not of the column's type makes the cell missing.
    With ``conflicts="fail"`` two rules that hold for one cell are an error. Rules on other columns
    are ignored; keys of ``df`` without rules, NULL among them, stay as they are."""
    if conflicts not in ("apply", "fail"):
        raise ValueError(f"unknown way to settle conflicts {conflicts!r}")
    if not isinstance(conditions, Mapping):
        conditions = {c: F.col(c) for c in conditions}
    own = rules.where(F.col("column_name").isin(*columns))
    # By the plain key, which no rule lacks: records that are dealt out by it stay where they are.
    joined = df.join(rules_per_key(own, key, list(conditions)), key, "left")
    # one list of a record's own rules, made once for all of its columns
    held = F.filter("__rules", lambda r: _holds(r, conditions))
    joined = joined.withColumn("__held", held)

    def corrected(c: str) -> Column:
        kind = df.schema[c].dataType
        mine = F.filter("__held", lambda r: r["column_name"] == c)
        number = isinstance(kind, T.NumericType)

        def step(value: Column, rule: Column) -> Column:
            new = rule["value"].try_cast(kind)
            added = (value + new).cast(kind) if number else F.raise_error(
                F.lit(f"add on the column {c}, which is no number")).cast(kind)
            return F.when(rule["op"] == SET, new).when(rule["op"] == ADD, added)

        done = F.aggregate(mine, F.col(c), step)
        if conflicts == "fail":
            done = F.when(F.size(mine) > 1, F.raise_error(F.concat(
                F.lit(f"several rules for {c} of "), F.col(key).cast("string"))).cast(kind)).otherwise(done)
        return F.when(F.size("__held") > 0, done).otherwise(F.col(c))

    fixed = joined.withColumns({c: corrected(c) for c in columns})
    return fixed.select(*df.columns)
