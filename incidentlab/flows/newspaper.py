"""Newspaper case list and its comparison with the crowd-sourced deaths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import names
from ..clean import recode_values
from ..io import stage
from ..link import join_presence
from ..rsem import first_match, level_rank, matches


def prepare(
    raw: DataFrame, state: str, county_codes: DataFrame | None = None,
    city_codes: DataFrame | None = None,
) -> DataFrame:
    """Cases of one state under lower-case names, with a date and place codes."""
    df = raw.where(F.col("ST") == state)
    df = df.withColumnsRenamed({c: c.lower() for c in df.columns}).withColumnsRenamed(
        {"county": "county_name", "city": "city_name", "date": "day", "seq": "case_id"}
    )
    df = df.withColumns({
        "city_name": recode_values("city_name", names.NEWSPAPER_CITY_SPELLINGS),
        "date": F.try_to_date(F.concat_ws("-", "year", "mo", "day"), "y-M-d"),
    })
    for codes, key in ((county_codes, "county_name"), (city_codes, "city_name")):
        if codes is not None:
            df = df.join(codes, key, "left")
    return df


def tag_candidates(deaths: DataFrame) -> DataFrame:
    """Deaths worth coding: 1 already coded, 2 vehicle words in the description, 3 cause
    of death is a vehicle. The rest is dropped."""
    tag = first_match([
        (F.col("vpursuit_draft").isNotNull(), 1),
        (matches("description", names.VEHICLE_WORDS), 2),
        (F.col("cod") == "Vehicle", 3),
    ])
    return deaths.withColumn("pursuit_tag", tag).where(F.col("pursuit_tag").isNotNull())


def apply_coding(candidates: DataFrame, coded: DataFrame, key: str = "fe_id") -> DataFrame:
    """Attach the manual coding (final over draft) and derive the pursuit type. ``coded``
    has key, vpursuit_draft, vpursuit_final, victim_final, url_info, url_additional."""
    final = coded.select(
        key,
        F.initcap(F.coalesce("vpursuit_final", "vpursuit_draft")).alias("vpursuit"),
        F.col("victim_final").alias("victim"),
        F.coalesce("url_additional", "url_info").alias("url_info"),
    )
    kept = candidates.drop("vpursuit_draft", "vpursuit", "victim", "url_info")
    return kept.join(final, key, "left").withColumn(
        "pursuit_type",
        F.when(matches("vpursuit", "Active|Terminated"), "Pursuit").otherwise(F.col("vpursuit")),
    )


def compare(
    deaths: DataFrame, cases: DataFrame, death_id: str = "fe_id", case_id: str = "case_id"
) -> DataFrame:
    """Coded pursuit deaths and newspaper cases, paired one to one on county and date parts; every
    record of both occurs once. ``newspaper`` is 1 where a case is present."""
    related = deaths.where(F.col("pursuit_type") != "Reviewed Not Related").withColumn(
        "mo_num", level_rank("month", names.MONTH_ABBREVIATIONS)
    )
    return join_presence(
        stage(related), stage(cases.drop("date")),
        {"county": "county_name", "year": "year", "mo_num": "mo", "day": "day"}, "newspaper",
        (death_id, case_id),
    )
