"""Record linkage: the same person or event in several sources.

Keys are compared null-safely (two missing ages agree). Records that share a key are paired one
to one: the first left record by id with the first right record, the second with the second,
and so on. Surplus records of either side stay unpaired, so every record occurs exactly once
and a key of n left and m right records yields max(n, m) rows, not n * m. ``pairing="first"``
pairs every left record with the first right record of its key instead.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import names
from .io import stage
from .ordering import RANGE_ROWS, keep_first, largest_group, number_groups, number_within
from .rsem import first_match, null_safe_join

TAGGED, UNTAGGED, ABSENT = 2, 1, 0


def _suffixed(df: DataFrame, keys: Sequence[str], suffix: str) -> DataFrame:
    return df.withColumnsRenamed({c: c + suffix for c in df.columns if c not in keys})


ONE_TO_ONE, FIRST = "one_to_one", "first"


def _ranked(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str | None, right_id: str,
    pairing: str,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the columns to join on: the keys, and the rank inside the key."""
    if pairing == FIRST:
        return left, keep_first(right, keys, [right_id]), list(keys)
    if pairing != ONE_TO_ONE:
        raise ValueError(f"unknown pairing {pairing!r}")
    if left_id is None:
        raise ValueError("one-to-one pairing needs the left record id")
    return (number_within(left, keys, [left_id], "__nth"),
            number_within(right, keys, [right_id], "__nth"), [*keys, "__nth"])


def link_left(
    left: DataFrame, right: DataFrame, keys: Sequence[str], right_id: str,
    suffixes: tuple[str, str] = ("_a", "_b"), left_id: str | None = None,
    pairing: str = ONE_TO_ONE,
) -> DataFrame:
    """Every left record once, with its right record if there is one."""
    a, b, on = _ranked(left, right, keys, left_id, right_id, pairing)
    return null_safe_join(
        _suffixed(a, on, suffixes[0]), _suffixed(b, on, suffixes[1]), on, "left"
    ).drop("__nth")


def _met(
    left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str],
) -> DataFrame:
    """Both sides, with no column but the keys in common, one to one: rows of a key are numbered on
    either side in ``order`` (columns of both sides, NULL on the other one), and rows of one key
    and number become one row. No join: the sides are stacked and numbered together. Where every key
    fits a task, rows are dealt out by key once, for the numbering and the grouping."""
    both = left.withColumn("__side", F.lit(0)).unionByName(
        right.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    # rows that share the first key alone are at least as many, and cheaper to count
    if any(largest_group(both, part) <= RANGE_ROWS for part in (keys[:1], keys)):
        numbered = number_groups(both.repartition(*keys), [*keys, "__side"], order, "__nth")
    else:
        numbered = number_within(both, [*keys, "__side"], order, "__nth")
    # At most one row of each side is in a group.
    cells = [c for c in both.columns if c not in keys and c != "__side"]
    return numbered.groupBy(*keys, "__nth").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in cells]).drop("__nth")


def link_full(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str,
    suffixes: tuple[str, str] = ("_a", "_b"), pairing: str = ONE_TO_ONE,
) -> DataFrame:
    """Full linkage: each record of either side once, paired or alone (with pairing "first":
    each left record, and each right record whose keys no left record has). Columns other
    than the keys get the suffixes.

    ``left_id`` and ``right_id`` name the record ids; they must be unique and non-NULL, as the
    match status is read from them. Hand over stored tables: both sides are read twice."""
    if left_id not in left.columns:
        raise ValueError(f"{left_id} is not a column of the left frame")
    if pairing == ONE_TO_ONE:
        a, b = _suffixed(left, keys, suffixes[0]), _suffixed(right, keys, suffixes[1])
        return _met(a, b, keys, [left_id + suffixes[0], right_id + suffixes[1]])
    a, b, on = _ranked(left, right, keys, left_id, right_id, pairing)
    paired = null_safe_join(
        _suffixed(a, on, suffixes[0]), _suffixed(b, on, suffixes[1]), on, "left")
    alone = null_safe_join(right, a.select(*on).distinct(), on, "left_anti")
    return paired.unionByName(_suffixed(alone, on, suffixes[1]), allowMissingColumns=True)


def status(df: DataFrame, specs: Mapping[str, tuple[str, int]]) -> DataFrame:
    """Match status per source: ``specs`` maps the output column to (record id column,
    code when present); an absent record is 0."""
    return df.withColumns(
        {
            out: F.when(F.col(rec).isNotNull(), F.lit(code)).otherwise(F.lit(ABSENT))
            for out, (rec, code) in specs.items()
        }
    )


def tag_status(crowd: str, a: str, b: str) -> Column:
    """Which side carried the tag, from the three status columns."""
    in_crowd, a_col, b_col = F.col(crowd), F.col(a), F.col(b)
    either_tagged = (a_col == TAGGED) | (b_col == TAGGED)
    return first_match(
        [
            ((in_crowd == TAGGED) & (a_col < TAGGED) & (b_col < TAGGED), names.TAGGED_CROWD),
            ((in_crowd == ABSENT) & either_tagged, names.TAGGED_AGENCY),
            ((in_crowd == TAGGED) & either_tagged, names.TAGGED_BOTH),
        ],
        names.TAGGED_OTHER,
    )


def cascade(
    left: DataFrame, tiers: Sequence[tuple[str, DataFrame, str, Sequence[str]]],
    carry: Sequence[str] = (), rest: str = "unmatched", left_id: str | None = None,
    pairing: str = ONE_TO_ONE,
) -> DataFrame:
    """Match against one pool after another, handing each tier's leftovers to the next.

    ``tiers`` lists (label, pool, pool id, keys). The result has one row per left record:
    its columns, ``tier``, ``match_id`` (NULL for the unmatched rest) and the ``carry``
    columns of the matched pool record (present, with one type, in every pool).

    One-to-one, every pool record is used once. Tiers that follow each other on the same keys are
    one step: their pools are put one behind the other, in the order of the tiers, so that the
    records that the first pool leaves over meet the next one without another exchange. What a step
    leaves over is stored and goes on to the next. Pools must not overlap, but one frame may serve
    several tiers: what an earlier one took from it is gone. With pairing "first" all tiers are attached in
    one pass and the earliest hit is kept, as a tier's hit then depends on its own keys alone."""
    if pairing != FIRST:
        return _cascade_pairs(left, tiers, carry, rest, left_id)
    out = left
    for i, (_, pool, pool_id, keys) in enumerate(tiers):
        record = F.struct(
            F.col(pool_id).cast("string").alias("match_id"), *[F.col(c) for c in carry]
        )
        best = keep_first(pool, keys, [pool_id]).select(*keys, record.alias(f"__hit_{i}"))
        out = null_safe_join(out, best, keys, "left")
    hits = [F.col(f"__hit_{i}") for i in range(len(tiers))]
    won = F.coalesce(*hits)
    return out.withColumns({
        "tier": first_match([(h.isNotNull(), t[0]) for h, t in zip(hits, tiers)], rest),
        "match_id": won["match_id"],
        **{c: won[c] for c in carry},
    }).drop(*[f"__hit_{i}" for i in range(len(tiers))])


def _cascade_pairs(
    left: DataFrame, tiers: Sequence[tuple[str, DataFrame, str, Sequence[str]]],
    carry: Sequence[str], rest: str, left_id: str | None,
) -> DataFrame:
    if left_id is None:
        raise ValueError("one-to-one pairing needs the left record id")
    columns, done = left.columns, []
    taken: list[tuple[DataFrame, DataFrame]] = []
    for keys, step in groupby(tiers, lambda tier: list(tier[3])):
        pools, frames = [], []
        for number, (label, pool, pool_id, _) in enumerate(step):
            if any(pool is frame for frame in frames):
                continue  # the same records under the same keys: nothing is left of them
            frames.append(pool)
            own = pool.withColumn("match_id", F.col(pool_id).cast("string"))
            for earlier, used in taken:
                if earlier is pool:
                    own = null_safe_join(own, used, ["match_id"], "left_anti")
            record = F.struct(F.lit(label).alias("tier"), "match_id", *carry)
            pools.append(own.select(
                *keys, F.lit(number).alias("__tier"), F.col(pool_id).alias(f"__id_{number}"),
                record.alias("__hit")))
        pool = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pools)
        ids = [c for c in pool.columns if c.startswith("__id_")]
        own = F.struct(*[F.col(c) for c in columns if c not in keys]).alias("__own")
        tried = stage(_met(left.select(*keys, F.col(left_id).alias("__left"), own), pool, keys,
                           ["__left", "__tier", *ids]).where(F.col("__own").isNotNull()))
        back = [F.col(c) if c in keys else F.col(f"__own.{c}").alias(c) for c in columns]
        hit = tried.where(F.col("__hit").isNotNull())
        done.append(hit.select(*back, "__hit.*"))
        used = hit.select("__hit.match_id")
        taken += [(frame, used) for frame in frames]
        left = tried.where(F.col("__hit").isNull()).select(*back)
    return reduce(
        lambda x, y: x.unionByName(y, allowMissingColumns=True),
        [*done, left.withColumns({"tier": F.lit(rest), "match_id": F.lit(None).cast("string")})],
    )


def survive(
    df: DataFrame, preferred: Mapping[str, Sequence[str]],
    largest: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Consensus columns: first non-missing source, or the largest of several counts."""
    spec = {out: F.coalesce(*cols) for out, cols in preferred.items()}
    spec |= {out: F.greatest(*cols) for out, cols in (largest or {}).items()}
    return df.withColumns(spec)


def discrepancies(
    df: DataFrame, key: str, pairs: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """Rows where two sources disagree, long form (key, column_name, value_a, value_b);
    a value missing on either side is not a disagreement."""
    entries = F.array(*[
        F.struct(F.lit(name).alias("column_name"),
                 F.col(a).cast("string").alias("value_a"),
                 F.col(b).cast("string").alias("value_b"))
        for name, (a, b) in pairs.items()
    ])
    long = df.select(key, F.explode(entries).alias("e")).select(key, "e.*")
    return long.where(F.col("value_a") != F.col("value_b"))


def quality_crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of every (a, b) combination; missing is a level of its own."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def expand_members(
    matched: DataFrame, pool_a: DataFrame, pool_b: DataFrame, incident: str,
    carry: Sequence[str], keys: Sequence[str], a_id: str, b_id: str,
) -> DataFrame:
    """Remaining members of matched incidents, collected from both pools and linked.

    ``matched`` names the incidents and the columns each member inherits (``carry``, one
    row per incident). Members are paired one to one on incident + ``keys``."""
    incidents = matched.select(incident, *carry)
    members_a = stage(null_safe_join(pool_a, incidents.select(incident), [incident], "left_semi"))
    members_b = stage(null_safe_join(pool_b, incidents.select(incident), [incident], "left_semi"))
    linked = link_full(members_a, members_b, [incident, *keys], a_id, b_id)
    with_status = status(
        linked, {"status_a": (f"{a_id}_a", UNTAGGED), "status_b": (f"{b_id}_b", UNTAGGED)}
    )
    return null_safe_join(with_status, incidents, [incident], "left")


def membership(ids: DataFrame, key: str, sources: Mapping[str, DataFrame]) -> DataFrame:
    """Mark with 1 in which source each id occurs (NULL where it does not)."""
    return reduce(
        lambda acc, s: null_safe_join(
            acc, s[1].select(key).distinct().withColumn(s[0], F.lit(1)), [key], "left"
        ),
        sources.items(),
        ids,
    )


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left rows without a partner."""
    return null_safe_join(left, right.select(*keys).distinct(), keys, "left_anti")


def join_presence(
    left: DataFrame, right: DataFrame, keys: Mapping[str, str], marker: str,
    ids: tuple[str, str] | None = None,
) -> DataFrame:
    """All rows of both sides, joined by differently named keys (left name -> right name), with
    a 0/1 column telling whether the right side is present.

    With ``ids`` (the record ids of both sides) repeated keys are paired one to one. Without,
    both sides hold one row per key; a key that repeats on either is an error, not a product. Both
    sides are stacked and grouped by key, so each is read once, and counted in the same step."""
    on = list(keys)
    renamed = right.withColumnsRenamed({r: k for k, r in keys.items()}).withColumn(marker, F.lit(1))
    shared = [c for c in left.columns if c in renamed.columns and c not in on]
    if shared:
        raise ValueError(f"both sides have columns {shared}; rename them")
    if ids is not None:
        both = _met(left, renamed, on, ids)
    else:
        sides = left.withColumn("__left", F.lit(1)).unionByName(renamed, allowMissingColumns=True)
        cells = [c for c in sides.columns if c not in on and c != "__left"]
        both = sides.groupBy(*on).agg(
            *[F.first(c, ignorenulls=True).alias(c) for c in cells],
            F.greatest(F.count("__left"), F.count(marker)).alias("__most"))
        # checked where the marker is read, so that no plan leaves it out
        twice = F.raise_error(F.lit("a side repeats a key; name the record ids")).cast("int")
        both = both.withColumn(
            marker, F.when(F.col("__most") > 1, twice).otherwise(F.col(marker))).drop("__most")
    return both.fillna(0, subset=[marker])


def duplicate_keys(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
