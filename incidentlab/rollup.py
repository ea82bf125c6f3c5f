"""Moving between the person, vehicle and incident grains."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import names
from .io import stage
from .ordering import RANGE_ROWS, group_sizes, keep_first, number_groups, number_within
from .rsem import ColumnLike, as_column, first_match, flag, known_level, matches, null_safe_join, strict_count


def attach_group(df: DataFrame, key: str | Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Add group aggregates to every row of the group.

    Pre-aggregated on the map side and joined back, rather than a window: a window would
    bring a whole group into one task, whatever its size."""
    keys = [key] if isinstance(key, str) else list(key)
    totals = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return null_safe_join(df, totals, keys, "left")


def together(df: DataFrame, key: str, matched: DataFrame | None = None) -> DataFrame | None:
    """The rows dealt out by the key, if each of its groups fits a task; None if one does not. Windows
    over the key, alone or with further columns, and joins by the key alone then move no row again.
    ``matched`` is a table that such a join brings in: a group has to fit with all of its matches."""
    rows, largest = group_sizes(df, [key], matched)
    if largest > RANGE_ROWS:
        return None
    # A task that sorts more rows than that may have to spill them.
    least = -(-rows // RANGE_ROWS)
    few = least > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(least, key) if few else df.repartition(key)


def propagate_within(
    df: DataFrame, key: str, cond: Column, unit: str, out: str = "flagged_unit",
    aggs: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``propagate`` by windows, for rows that ``together`` has dealt out. ``aggs`` are aggregates of
    all records of the incident."""
    # Frames of whole groups, in orders that begin with the key and the unit.
    whole, own, units = (Window.partitionBy(key), Window.partitionBy(key, unit),
                         Window.partitionBy(key).orderBy(unit))
    flagged = F.coalesce(cond, F.lit(False))
    df = df.withColumns({
        f"in_{out}": F.max(flagged).over(own).cast("int"),
        "__head": F.rank().over(units) == F.row_number().over(units),
    })
    return df.withColumns({
        out: F.min(F.when(flagged, F.col(unit))).over(whole),
        f"{out}s": F.count_if(F.col("__head") & (F.col(f"in_{out}") == 1)).over(whole),
        **{name: a.over(whole) for name, a in (aggs or {}).items()},
    }).drop("__head")


def propagate(
    df: DataFrame, key: str, cond: Column, unit: str, out: str = "flagged_unit",
    aggs: Mapping[str, tuple[Column, Callable[[str], Column]]] | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Spread a flag on some member to all records of the incident.

    Adds, without multiplying rows when several units are flagged:
    ``<out>`` the lowest flagged unit of the incident, ``<out>s`` how many distinct units
    are flagged (0 if none), ``in_<out>`` 1 when the record's own unit is one of them, and
    any further incident aggregates in ``aggs``: name to the aggregate of a unit and how the
    units' values are combined. Records are brought to units once, written, and units to
    incidents, so the rows are read twice in all; without ``aggs`` only the flagged records
    are. ``source`` may name an earlier state of
    ``df`` with the same rows, to aggregate from a shorter plan."""
    source, aggs = df if source is None else source, aggs or {}
    members = source if aggs else source.where(cond)
    units = stage(members.groupBy(key, unit).agg(
        F.max(F.coalesce(cond, F.lit(False))).alias("__flag"),
        *[own.alias(name) for name, (own, _) in aggs.items()]))
    incidents = units.groupBy(key).agg(
        F.min(F.when(F.col("__flag"), F.col(unit))).alias(out),
        F.count_if("__flag").alias(f"{out}s"),
        *[combine(name).alias(name) for name, (_, combine) in aggs.items()])
    own = units.where("__flag").select(key, unit, F.lit(1).alias(f"in_{out}"))
    df = null_safe_join(df, incidents, [key], "left")
    df = null_safe_join(df, own, [key, unit], "left")
    return df.fillna(0, subset=[f"{out}s", f"in_{out}"])


def first_by(
    df: DataFrame, key: str | Sequence[str], order: Sequence[ColumnLike],
    cols: Sequence[str] | Mapping[str, str],
) -> DataFrame:
    """One row per key with the listed columns of its first record. ``order`` must end in
    a unique column; the first record's own NULLs are kept."""
    keys = [key] if isinstance(key, str) else list(key)
    picked = firsts(order, cols)
    return df.groupBy(*keys).agg(picked.alias("__first")).select(*keys, "__first.*")


def firsts(order: Sequence[ColumnLike], cols: Sequence[str] | Mapping[str, str]) -> Column:
    """Aggregate: struct of the listed columns (name -> source) at the first record."""
    cols = cols if isinstance(cols, Mapping) else {c: c for c in cols}
    rank = [p for c in map(as_column, order) for p in (c.isNull(), c)]
    return F.min_by(
        F.struct(*[F.col(src).alias(name) for name, src in cols.items()]), F.struct(*rank)
    )


def nth_by(
    df: DataFrame, key: str, order: Sequence[ColumnLike], cols: Sequence[str], n: int
) -> DataFrame:
    """First to n-th value per key as columns ``<col>1 .. <col>n`` (NULL beyond the group)."""
    sort = F.struct(*[p for c in map(as_column, order) for p in (c.isNull(), c)])
    top = keep_first(df.select(key, *cols, sort.alias("__sort")), [key], ["__sort"], n)
    # At most n rows per key are collected.
    listed = top.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("__sort", *cols))).alias("__top")
    )
    return listed.select(
        key,
        *[F.get("__top", F.lit(i))[c].alias(f"{c}{i + 1}") for c in cols for i in range(n)],
    )


def incident_type() -> Column:
    """Incident type from the pursuit coding (``vpursuit``) and the suicide flag."""
    # The tests below and their order decide the result.
    return first_match(
        [
            (matches("vpursuit", "Active|Terminated"), "Pursuit vehicular fatality"),
            (matches("vpursuit", "Involved") & (F.col("suicide") == 1), "After pursuit suicide"),
            (matches("vpursuit", "Involved"), "After pursuit homicide"),
            (F.col("vpursuit") == "Attempted stop", "Attempted stop fatality"),
            (matches("vpursuit", "accident"), "Vehicle accident fatality"),
        ],
        "All other fatalities",
    )


FIRST_COLUMNS = {
    "date": "date", "year": "year", "month": "month", "day": "day", "leg_year": "leg_year",
    "policy_period": "policy_period", "vpursuit": "vpursuit", "incident_type": "incident_type",
    "lat": "latitude", "long": "longitude", "agency": "agency", "agency_type": "agency_type",
    "city": "city", "county": "county", "district": "district",
    "url_info": "url_info", "url_click": "url_click",
}


def rollup_incidents(
    deaths: DataFrame, key: str = "incident_num", order: Sequence[ColumnLike] = ("rec_id",),
    first_columns: Mapping[str, str] = FIRST_COLUMNS,
) -> DataFrame:
    """Person records to one row per incident: descriptive columns from the first record,
    numbers killed and injured per victim group, and their sums and any-flags."""
    groups = ["subjects", "passengers", "bystanders", "officers"]
    label = {"subjects": "Subject", "passengers": "Passenger",
             "bystanders": "Bystander", "officers": "Officer"}
    base = deaths.groupBy(key).agg(
        firsts(order, first_columns).alias("__first"),
        F.count(F.lit(1)).alias("fatalities"),
        F.count_if(matches("victim", "Subject")).alias("subjects_killed"),
        *[strict_count(F.col("victim") == label[g]).alias(f"{g}_killed") for g in groups[1:]],
        *[F.count_if(matches("injury", label[g])).alias(f"{g}_injured") for g in groups],
    ).select(key, "__first.*", "fatalities",
             *[f"{g}_{what}" for what in ("killed", "injured") for g in groups])

    # Only incidents with some pursuit relation carry these counts.
    related = ~matches("vpursuit", "not related")
    masked = ["subjects_killed", *[f"{g}_injured" for g in groups]]
    base = base.withColumns({c: F.when(related, F.col(c)) for c in masked})

    def add(*cols: str) -> Column:
        total = F.col(cols[0])
        for c in cols[1:]:
            total = total + F.col(c)
        return total

    sums = base.withColumns({
        "inci_mapmult": F.when(F.col("fatalities") == 1, "single").otherwise("mult"),
        "pbo_killed": add("passengers_killed", "bystanders_killed", "officers_killed"),
        "pb_killed": add("passengers_killed", "bystanders_killed"),
        "total_injuries": add(*[f"{g}_injured" for g in groups]),
        "pbo_injured": add("passengers_injured", "bystanders_injured", "officers_injured"),
        "pb_injured": add("passengers_injured", "bystanders_injured"),
    }).withColumns({
        "pbo_total": add("pbo_killed", "pbo_injured"),
        "pb_total": add("pb_killed", "pb_injured"),
    })
    return sums.withColumns({
        "pbo_any": flag(F.col("pbo_total") > 0),
        "pb_any": flag(F.col("pb_total") > 0),
    })


def subset_tags() -> dict[str, Column]:
    """The nested report subsets as conditions on ``incident_type``."""
    pursuit = matches("incident_type", "Pursuit|pursuit")
    after = matches("incident_type", "After")
    return {
        "all": F.lit(True),
        "pursuit": pursuit,
        "vehicular": pursuit & ~after,
        "after": pursuit & after,
        "stop": matches("incident_type", "stop"),
    }


def subset(df: DataFrame, name: str) -> DataFrame:
    """Rows of one report subset: all, pursuit, vehicular, after or stop."""
    return df.where(subset_tags()[name])


def person_ids(
    df: DataFrame, incident: str, unit: str, order: Sequence[ColumnLike], dealt: bool = False
) -> DataFrame:
    """Give a running person number inside (incident, unit), and the record id
    ``<incident>u<unit>p<number>`` built from it. ``dealt`` says that the rows come from
    ``together`` by incident."""
    number = number_groups if dealt else number_within
    numbered = number(df, [incident, unit], order, out="person_no")
    return numbered.withColumn(
        "record_id",
        F.concat(F.col(incident).cast("string"), F.lit("u"), F.col(unit).cast("string"),
                 F.lit("p"), F.col("person_no").cast("string")),
    )


def with_previous(
    df: DataFrame, keys: Sequence[str], number: str, cols: Mapping[str, str]
) -> DataFrame:
    """Values of the previous record in the group (new name -> column), NULL for the first one.
    ``number`` is the running number; records meet their predecessor by key and number, so a
    group of any size is spread over tasks."""
    before = df.select(*keys, (F.col(number) + 1).alias(number),
                       *[F.col(c).alias(out) for out, c in cols.items()])
    return null_safe_join(df, before, [*keys, number], "left")


def known_victims(df: DataFrame) -> DataFrame:
    """Victim groups outside the fixed level list become NULL."""
    return df.withColumn("victim", known_level("victim", names.VICTIM_LEVELS))
