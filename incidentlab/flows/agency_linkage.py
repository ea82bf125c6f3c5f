"""Linking source A person records to source B, for incidents that A or B tagged."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..io import stage
from ..link import ABSENT, TAGGED, UNTAGGED, link_full, status, survive
from ..rollup import first_by, nth_by
from ..rsem import null_safe_join

KEYS = ["incident", "county_code", "age", "sex"]

PREFERRED = ["pcat_v", "pcat_p", "injury", "parked_empty_car", "city_code", "fatals", "vnum", "vnum_p", "date"]
LARGEST = ["persons", "vehicles", "records"]


@dataclass(frozen=True)
class Linked:
    """Consensus frames at each grain."""

    records: DataFrame
    persons: DataFrame
    fatalities: DataFrame
    incidents: DataFrame


def link_records(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row per linked record with both sources' columns (suffix _a, _b) and status.

    First pass: tagged against tagged. Second pass: what is left of A against every B
    record of the incidents in which the first pass paired nothing. B records tagged in an
    incident with pairs, but themselves without a partner, are kept as B-only."""
    tagged = F.col("pursuit_tag") == 1
    has_a, has_b = F.col("record_id_a").isNotNull(), F.col("record_id_b").isNotNull()
    # Four branches read the first pass, two its counts, so both are computed once.
    first = stage(link_full(a.where(tagged), b.where(tagged), KEYS, "record_id", "record_id"))
    counts = stage(first.groupBy("incident").agg(F.count_if(has_a & has_b).alias("pairs")))
    matched = first.where(has_a & has_b).withColumns(
        {"status_a": F.lit(TAGGED), "status_b": F.lit(TAGGED)}
    )
    paired = counts.where(F.col("pairs") > 0).select("incident")
    stray_b = null_safe_join(first.where(~has_a), paired, ["incident"], "left_semi").withColumns(
        {"status_a": F.lit(ABSENT), "status_b": F.lit(TAGGED)}
    )
    left_a = first.where(has_a & ~has_b).select(
        *KEYS, *[F.col(f"{c}_a").alias(c) for c in a.columns if c not in KEYS]
    )
    open_incidents = counts.where(F.col("pairs") == 0).select("incident")
    pool_b = stage(null_safe_join(b, open_incidents, ["incident"], "left_semi"))
    second = status(
        link_full(left_a, pool_b, KEYS, "record_id", "record_id"),
        {"status_a": ("record_id_a", TAGGED), "status_b": ("record_id_b", UNTAGGED)},
    )
    return matched.unionByName(second).unionByName(stray_b)


def consensus(linked: DataFrame, pursued_units: DataFrame | None = None) -> DataFrame:
    """Consensus columns, A preferred; counts take the larger source. ``pursued_units``
    (incident, vnum_p) supplies the (lowest) pursued vehicle where A has no record."""
    df = linked
    if pursued_units is not None:
        # several pursued vehicles do not multiply the incident's records
        unit = pursued_units.groupBy("incident").agg(F.min("vnum_p").alias("__vnum_p"))
        df = null_safe_join(df, unit, ["incident"], "left")
        df = df.withColumn("vnum_p_a", F.coalesce("vnum_p_a", "__vnum_p")).drop("__vnum_p")
    df = survive(
        df,
        {f"{c}_w" if c != "date" else "date": [f"{c}_a", f"{c}_b"] for c in PREFERRED},
        {f"{c}_w": [f"{c}_a", f"{c}_b"] for c in LARGEST},
    )
    return df.withColumns({
        "year": F.year("date"), "month": F.month("date"), "pursuit_crash_w": F.lit(1),
        "record_id_w": F.coalesce(
            F.concat(F.lit("a:"), "record_id_a"), F.concat(F.lit("b:"), "record_id_b")
        ),
    })


def incidents(records: DataFrame, fatalities: DataFrame) -> DataFrame:
    """One row per incident: best status, first-record attributes, first two fatalities."""
    base = records.groupBy("incident").agg(
        F.max("status_a").alias("status_a"), F.max("status_b").alias("status_b"),
        F.count(F.lit(1)).alias("records_w"),
    )
    head = first_by(records, "incident", ["record_id_w"], [
        "year", "month", "date", "county_code", "city_code_w", "persons_w", "vehicles_w",
        "fatals_w", "vnum_p_w",
    ])
    dead = nth_by(fatalities, "incident", ["record_id_w"], ["pcat_p_w", "vnum_w"], 2)
    dead = dead.withColumnsRenamed({
        "pcat_p_w1": "fatal_pcat_p1_w", "pcat_p_w2": "fatal_pcat_p2_w",
        "vnum_w1": "fatal_vnum1_w", "vnum_w2": "fatal_vnum2_w",
    })
    whole = null_safe_join(base, head, ["incident"], "inner")
    return null_safe_join(whole, dead, ["incident"], "left")


def build(a: DataFrame, b: DataFrame, pursued_units: DataFrame | None = None) -> Linked:
    """From the minimal frames of both sources (stored tables) to the consensus frames."""
    records = stage(consensus(link_records(a, b), pursued_units))
    persons = records.where(F.col("parked_empty_car_w") != 1)
    fatalities = persons.where(F.col("injury_w") == "fatal")
    return Linked(records, persons, fatalities, incidents(records, fatalities))
