"""Linking crowd-sourced deaths to the agencies' consensus fatalities and, failing that,
to untagged fatalities of source A and then source B."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import names
from ..clean import recode_values
from ..link import ABSENT, TAGGED, UNTAGGED, cascade, expand_members, tag_status
from ..rollup import attach_group, first_by, nth_by
from ..rsem import first_match, null_safe_join

KEYS = ["date", "county_code", "age", "sex"]
CARRY = ["incident", "pcat_v", "pcat_p", "persons", "vehicles", "fatals", "records", "city_code"]


def prepare(
    deaths: DataFrame, city_codes: DataFrame | None = None, county_codes: DataFrame | None = None
) -> DataFrame:
    """Pursuit-related crowd records in the agencies' layout (suffix _fe on what is not a key)."""
    df = deaths.where(F.col("pursuit_type") != "Reviewed not related").withColumns({
        "sex": first_match(
            [(F.col("gender") == "Male", "M"), (F.col("gender") == "Female", "F")], "O/U"
        ),
        "city_name": recode_values("city", names.NEAREST_CITY),
    })
    if city_codes is not None:
        df = df.join(city_codes, "city_name", "left")
    if county_codes is not None:
        df = df.join(county_codes.withColumnRenamed("county_name", "county"), "county", "left")
    return df.select(
        "fe_id", F.col("incident_num").alias("incident_fe"), "date", "county_code", "age", "sex",
        F.col("city_code").alias("city_code_fe"), F.col("vpursuit").alias("vpursuit_fe"),
        F.col("cod").alias("cod_fe"), F.col("victim").alias("pcat_p_fe"),
        F.col("injury").alias("other_injuries_fe"), F.lit(TAGGED).alias("status_fe"),
        F.col("county").alias("county_name_fe"), F.col("city_name").alias("city_name_fe"),
    )


def with_incident_summary(crowd: DataFrame) -> DataFrame:
    """Add the incident's number of persons and its first two person categories."""
    df = attach_group(crowd, "incident_fe", {"persons_fe": F.count(F.lit(1))})
    pair = nth_by(crowd, "incident_fe", ["fe_id"], ["pcat_p_fe"], 2).withColumnsRenamed(
        {"pcat_p_fe1": "pcat_p1_fe", "pcat_p_fe2": "pcat_p2_fe"}
    )
    return null_safe_join(df, pair, ["incident_fe"], "left")


def fatalities(
    crowd: DataFrame, agency: DataFrame, pool_a: DataFrame, pool_b: DataFrame,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """One row per crowd death (with the tier it was found in) and per agency fatality
    that was paired with no crowd death. Every record of both occurs once.

    ``agency``, ``pool_a`` and ``pool_b`` carry the keys, ``record_id`` and the columns in
    ``CARRY``; ``agency`` also ``status_a`` and ``status_b``. Rows that are not persons
    (empty cars) must be gone from the pools: they share missing ages and sexes."""
    statuses = ["status_a", "status_b"]
    pools = [
        agency,
        pool_a.withColumns({"status_a": F.lit(UNTAGGED), "status_b": F.lit(UNTAGGED)}),
        pool_b.withColumns({"status_a": F.lit(ABSENT), "status_b": F.lit(UNTAGGED)}),
    ]
    found = cascade(
        crowd,
        [(label, pool, "record_id", keys) for label, pool in zip((names.FOUND_BOTH, names.FOUND_VIA_A, names.FOUND_VIA_B), pools)],
        carry=[*CARRY, *statuses], rest=names.CROWD_ONLY, left_id="fe_id",
    ).withColumnRenamed("tier", "inclusion").fillna(ABSENT, subset=statuses)
    taken = found.where(F.col("inclusion") == names.FOUND_BOTH).select("match_id")
    rest = agency.withColumn("match_id", F.col("record_id").cast("string"))
    missed = null_safe_join(rest, taken, ["match_id"], "left_anti").select(
        *keys, *CARRY, *statuses, "match_id",
        F.lit(ABSENT).alias("status_fe"), F.lit(names.AGENCY_ONLY).alias("inclusion"),
    )
    df = found.unionByName(missed, allowMissingColumns=True)
    return df.withColumns({
        "incident_id": F.coalesce(F.col("incident").cast("string"), F.col("incident_fe").cast("string")),
        "pursuit_type": F.coalesce("vpursuit_fe", F.lit("Active pursuit")),
        "tag_status": tag_status("status_fe", "status_a", "status_b"),
        "status_w": ((F.col("status_a") != ABSENT) | (F.col("status_b") != ABSENT)).cast("int"),
        "city_code": F.coalesce("city_code", "city_code_fe"),
        "year": F.year("date"), "month": F.month("date"),
    })


def nonfatal_members(
    linked: DataFrame, pool_a: DataFrame, pool_b: DataFrame, keys: Sequence[str] = ("age", "sex", "pcat_v")
) -> DataFrame:
    """Surviving members of the incidents that were found only through the crowd source."""
    found = linked.where(F.col("inclusion").isin(names.FOUND_VIA_A, names.FOUND_VIA_B))
    incidents = first_by(
        found, "incident", ["fe_id"], ["inclusion", "tag_status", "incident_fe", "fe_id", "pcat_p_fe"]
    )
    alive = F.col("injury") != "fatal"
    return expand_members(
        incidents, pool_a.where(alive), pool_b.where(alive), "incident",
        ["inclusion", "tag_status", "incident_fe", "fe_id", "pcat_p_fe"], keys,
        "record_id", "record_id",
    )


def all_records(fatal: DataFrame, nonfatal: DataFrame) -> DataFrame:
    """Fatal and non-fatal rows together with the overall agency status."""
    both = fatal.unionByName(nonfatal, allowMissingColumns=True)
    return both.withColumn("status_w2", F.coalesce("status_w", F.greatest("status_a", "status_b")))
