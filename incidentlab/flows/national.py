"""National crash files of several years and layouts, as one person table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..clean import any_code
from ..io import union_sources
from ..rsem import first_match, if_else_na, matches

# Factor codes and role codes of the national files.
DRIVER_FLEEING_CODE = 37
CRASH_PURSUIT_CODE = 20
FATAL_SEVERITY = 4
POLICE_VEHICLE = 5

PERSON_COLUMNS = [
    "ST_CASE", "VEH_NO", "PER_NO", "STR_VEH", "AGE", "SEXNAME", "PER_TYP", "INJ_SEV", "HISPANIC",
]
CRASH_COLUMNS = [
    "ST_CASE", "VE_TOTAL", "VE_FORMS", "PEDS", "PERSONS", "COUNTY", "CITY", "RUR_URBNAME",
    "LATITUDE", "FATALS",
]


@dataclass(frozen=True)
class Layout:
    """The files of all years that share a layout, each with a ``year`` column (the
    partition directory). Race moved to its own file in 2019; the wide factor columns of
    vehicle and crash became long factor files in 2020."""

    person: DataFrame
    vehicle: DataFrame
    crash: DataFrame
    race: DataFrame | None = None
    driver_factors: DataFrame | None = None
    crash_factors: DataFrame | None = None


@dataclass(frozen=True)
class Files:
    """One frame per kind of file, over all years, each with a ``year`` column. Layouts differ by
    year, so every frame has the columns of all layouts, as one reader with a declared schema gives
    them: what a year's files lack is NULL."""

    person: DataFrame
    vehicle: DataFrame
    crash: DataFrame
    race: DataFrame
    driver_factors: DataFrame
    crash_factors: DataFrame


@dataclass(frozen=True)
class Eras:
    """First years of the later layouts: race in a file of its own, factors in long files."""

    race_file: int = 2019
    factor_files: int = 2020


def case_date(month: str, day: str) -> Column:
    """Date in the row's own year; impossible parts (unknown-day codes) give NULL."""
    text = F.concat_ws("-", "year", month, day)
    return F.try_to_date(text, "y-M-d")


def role() -> Column:
    """Person role; NULL for people in crashes without any pursuit flag."""
    # The tests below and their order decide the result.
    driver, crash = F.col("pursuit_driver") == 1, F.col("pursuit_crash") == 1
    return first_match([
        (F.col("PER_TYP") == 99, "Unknown"),
        (F.col("PER_TYP").isin(1, 2, 9) & (F.col("SPEC_USE") == POLICE_VEHICLE), "Officer"),
        ((F.col("PER_TYP") == 1) & driver, "Subject"),
        (F.col("PER_TYP").isin(2, 9) & driver, "Passenger"),
        (driver | crash, "Bystander"),
    ])


def _person(files: Layout) -> DataFrame:
    has_race = "RACE" in files.person.columns
    return files.person.select(
        "year",
        case_date("MONTH", "DAY").alias("date"),
        if_else_na(F.col("INJ_SEV") == FATAL_SEVERITY, case_date("DEATH_MO", "DEATH_DA"), F.lit(None))
        .cast("date").alias("death_date"),
        *PERSON_COLUMNS,
        *(["RACE"] if has_race else []),
    )


def _vehicle(files: Layout) -> DataFrame:
    df = files.vehicle
    if files.driver_factors is None:
        fleeing = any_code([f"DR_SF{i}" for i in range(1, 5)], DRIVER_FLEEING_CODE)
        return df.select("year", "ST_CASE", "VEH_NO", "SPEC_USE", fleeing.alias("pursuit_driver"))
    # A vehicle has one row per factor; reduce to one flag so that its people stay single.
    factors = files.driver_factors.groupBy("year", "ST_CASE", "VEH_NO").agg(
        F.max(matches("DRIVERRFNAME", "Pursuing").cast("int")).alias("pursuit_driver")
    )
    return df.select("year", "ST_CASE", "VEH_NO", "SPEC_USE").join(
        factors, ["year", "ST_CASE", "VEH_NO"], "left"
    )


def _crash(files: Layout) -> DataFrame:
    df = files.crash
    base = ["year", *CRASH_COLUMNS, F.col("LONGITUD").alias("LONGITUDE")]
    if files.crash_factors is None:
        flagged = any_code([f"CF{i}" for i in range(1, 4)], CRASH_PURSUIT_CODE)
        return df.select(*base, flagged.alias("pursuit_crash"))
    factors = files.crash_factors.groupBy("year", "ST_CASE").agg(
        F.max(matches("CRASHRFNAME", "Pursuit").cast("int")).alias("pursuit_crash")
    )
    return df.select(*base).join(factors, ["year", "ST_CASE"], "left")


def build(
    layouts: Sequence[Layout], state: str | None = None,
    county_codes: DataFrame | None = None, city_codes: DataFrame | None = None,
) -> DataFrame:
    """One row per person over all years: harmonised columns, flags and role.

    Each layout is projected to common columns first; the person, vehicle and crash joins
    then run once over all years, keyed by year."""
    if state is not None:
        layouts = [_only(files, state) for files in layouts]
    person = union_sources([_person(f) for f in layouts])
    vehicle = union_sources([_vehicle(f) for f in layouts])
    crash = union_sources([_crash(f) for f in layouts])
    races = [
        f.race.select("year", "ST_CASE", "VEH_NO", "PER_NO", F.col("RACE").alias("__race"))
        for f in layouts if f.race is not None
    ]
    if races:
        person = person.join(union_sources(races), ["year", "ST_CASE", "VEH_NO", "PER_NO"], "left")
        known = F.coalesce("RACE", "__race") if "RACE" in person.columns else F.col("__race")
        person = person.withColumn("RACE", known).drop("__race")
    return _together(person, vehicle, crash, county_codes, city_codes)


def build_by_year(
    files: Files, eras: Eras = Eras(), state: str | None = None,
    county_codes: DataFrame | None = None, city_codes: DataFrame | None = None,
) -> DataFrame:
    """``build`` from one frame per kind of file: each is read once, and the year of a row, not
    the file it came from, tells which layout's rule applies to it."""
    if state is not None:
        here = F.col("STATENAME") == state
        files = Files(**{f.name: getattr(files, f.name).where(here) for f in fields(files)})
    late_race, late_factors = F.col("year") >= eras.race_file, F.col("year") >= eras.factor_files
    races = files.race.where(late_race).select(
        "year", "ST_CASE", "VEH_NO", "PER_NO", F.col("RACE").alias("__race"))
    person = _person(Layout(files.person, files.vehicle, files.crash)).join(
        races, ["year", "ST_CASE", "VEH_NO", "PER_NO"], "left")
    person = person.withColumn(
        "RACE", F.when(late_race, F.col("__race")).otherwise(F.col("RACE"))).drop("__race")
    driver = files.driver_factors.where(late_factors).groupBy("year", "ST_CASE", "VEH_NO").agg(
        F.max(matches("DRIVERRFNAME", "Pursuing").cast("int")).alias("__long"))
    fleeing = any_code([f"DR_SF{i}" for i in range(1, 5)], DRIVER_FLEEING_CODE)
    vehicle = files.vehicle.join(driver, ["year", "ST_CASE", "VEH_NO"], "left").select(
        "year", "ST_CASE", "VEH_NO", "SPEC_USE",
        F.when(late_factors, F.col("__long")).otherwise(fleeing).alias("pursuit_driver"))
    factors = files.crash_factors.where(late_factors).groupBy("year", "ST_CASE").agg(
        F.max(matches("CRASHRFNAME", "Pursuit").cast("int")).alias("__long"))
    flagged_crash = any_code([f"CF{i}" for i in range(1, 4)], CRASH_PURSUIT_CODE)
    crash = files.crash.join(factors, ["year", "ST_CASE"], "left").select(
        "year", *CRASH_COLUMNS, F.col("LONGITUD").alias("LONGITUDE"),
        F.when(late_factors, F.col("__long")).otherwise(flagged_crash).alias("pursuit_crash"))
    return _together(person, vehicle, crash, county_codes, city_codes)


def _together(
    person: DataFrame, vehicle: DataFrame, crash: DataFrame, county_codes: DataFrame | None,
    city_codes: DataFrame | None,
) -> DataFrame:
    out = person.join(vehicle, ["year", "ST_CASE", "VEH_NO"], "left").join(
        crash, ["year", "ST_CASE"], "left"
    )
    if county_codes is not None:
        out = out.join(county_codes.withColumnRenamed("county_code", "COUNTY"), "COUNTY", "left")
    if city_codes is not None:
        out = out.join(city_codes.withColumnRenamed("city_code", "CITY"), "CITY", "left")
    return out.withColumn("victim", role())


def _only(files: Layout, state: str) -> Layout:
    """Filter every file at the scan."""
    here = F.col("STATENAME") == state
    kept = {f.name: getattr(files, f.name) for f in fields(files)}
    return Layout(**{n: None if d is None else d.where(here) for n, d in kept.items()})


def flagged(persons: DataFrame) -> DataFrame:
    """People in crashes with a pursuit flag on the crash or the driver."""
    return persons.where((F.col("pursuit_crash") == 1) | (F.col("pursuit_driver") == 1))
