"""State person files (source A): harmonise years, flag chases, classify persons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import names
from ..clean import any_code, fill_zero, recode_values
from ..corrections import correct
from ..io import stage, union_sources
from ..rollup import propagate, propagate_within, together
from ..rsem import first_match, if_else_na

# Factor codes of the state person files.
FLEEING_DRIVER = 37
OFFICER_DRIVER = 16
CRASH_PURSUIT = 20

FACTOR_COLUMNS = {
    "cf": ["cf1", "cf2", "cf3"],
    "crf": ["crf1", "crf2", "crf3"],
    "drf": ["drf1", "drf2", "drf3", "drf4"],
}

MIN_COLUMNS = [
    "incident", "record_id", "pursuit_tag", "pursuit_driver", "pursuit_crash", "county_code",
    "city_code", "date", "pcat_p", "pcat_v", "vnum", "vnum_p", "numoccs", "parked_empty_car",
    "age", "sex", "race", "hispanic", "injury", "persons", "vehicles", "records", "fatals",
]


#: Columns that corrections may touch.
CORRECTED = ["pursuit_driver", "pforms", "vforms", "is_officer"]


def record_id() -> Column:
    """``<par>v<vehicle>p<person>``, person 999 where unnumbered."""
    return F.concat(
        F.col("par"), F.lit("v"), F.col("vnumber").cast("string"),
        F.lit("p"), F.coalesce(F.col("pnumber"), F.lit(999)).cast("string"),
    )


def injury_label(code: str) -> Column:
    # The tests below and their order decide the result.
    c = F.col(code)
    return first_match([
        (c == 4, "fatal"), (c == 3, "serious injury"), (c.isin(1, 2, 5), "minor injury"),
        (c == 0, "no injury"),
    ], "Unknown")


def sex_label(code: str) -> Column:
    # The tests below and their order decide the result.
    return first_match([(F.col(code) == 1, "M"), (F.col(code) == 2, "F")], "O/U")


def _police() -> Column:
    return (F.col("ptype").isin(1, 2, 5, 9) & (F.col("spuse") == 5)) | (F.col("is_officer") == 1)


def person_category() -> Column:
    # The tests below and their order decide the result.
    ptype = F.col("ptype")
    return first_match([
        (_police(), "Officer"),
        (ptype == 1, "Driver"),
        (ptype.isin(2, 9), "Passenger"),
        (ptype == 3, "Parked car occupant"),
        (ptype.isin(5, 6, 7, 12, 13, 19), "Non-motorist"),
        (F.col("parked_empty_car") == 1, "Parked empty car"),
    ], "Other")


def pursuit_role() -> Column:
    # The tests below and their order decide the result.
    ptype = F.col("ptype")
    return first_match([
        (F.col("pursuit_tag") == 0, "Not tagged pursuit"),
        (_police(), "Officer"),
        ((ptype == 1) & (F.col("pursuit_driver") == 1), "Subject"),
        (ptype.isin(2, 9) & (F.col("in_flagged_unit") == 1), "Passenger"),
        (F.col("parked_empty_car") == 1, "Parked empty car"),
        (F.col("pursuit_tag") == 1, "Bystander"),
    ])


def flags(df: DataFrame) -> DataFrame:
    """Pursuit, officer and empty-car flags from the factor codes (missing code = 0)."""
    df = fill_zero(df, [c for cols in FACTOR_COLUMNS.values() for c in cols])
    df = df.withColumns({
        "pursuit_driver": any_code(FACTOR_COLUMNS["drf"], FLEEING_DRIVER),
        "pursuit_crash": any_code(FACTOR_COLUMNS["cf"] + FACTOR_COLUMNS["crf"], CRASH_PURSUIT),
        "is_officer": any_code(FACTOR_COLUMNS["drf"], OFFICER_DRIVER),
        "parked_empty_car": if_else_na(
            (F.col("regowner") == 6) & (F.col("numoccs") == 0), F.lit(1), F.lit(0)
        ),
    })
    return df.withColumn("pursuit_tag", any_code(["pursuit_driver", "pursuit_crash"], 1))


def _add_factors(raw: DataFrame, factors: DataFrame, dealt: bool) -> DataFrame:
    """Factor columns of the separate delivery where the person file has none; not for records of the
    supplement. ``dealt`` says that the rows come from ``together`` by incident: they are joined by it
    and held against the years of its factors, as a join by both keys would move them again."""
    new = [c for c in factors.columns if c not in ("par", "year")]
    delivered = factors.select(*[F.col(c).alias(f"__{c}") for c in ["par", "year", *new]])
    year = F.col("year").between(F.col("__year"), F.col("__year")) if dealt else F.col("year") == F.col("__year")
    joined = raw.join(delivered, (F.col("par") == F.col("__par")) & year & ~F.col("__supplement"), "left")
    value = {c: F.coalesce(c, f"__{c}") if c in raw.columns else F.col(f"__{c}") for c in new}
    return joined.withColumns(value).drop(*delivered.columns)


def build(
    years: Sequence[DataFrame], factors: DataFrame | None = None, extra: DataFrame | None = None,
    fixes: DataFrame | None = None, city_codes: DataFrame | None = None,
) -> DataFrame:
    """All person records. ``factors`` adds the contributing-factor columns delivered
    separately for early years, ``extra`` is a hand-transcribed supplement in the same
    layout, ``fixes`` rules of ``corrections`` by ``par`` and, if they say so, record: drivers and
    officers that the factors do not show, counts that are too low."""
    raw = union_sources(years, {"accmon": "double", "accday": "double"}).withColumn("__supplement", F.lit(False))
    if extra is not None:
        raw = union_sources([raw, extra.withColumn("__supplement", F.lit(True))])
    # Factors, corrections, flags and totals all go by the incident, so its records move once for them.
    dealt = together(raw, "par", factors)
    df = raw if dealt is None else dealt
    if factors is not None:
        df = _add_factors(df, factors, dealt is not None)
    df = flags(df.drop("__supplement"))
    if fixes is not None:
        df = correct(df, fixes, "par", CORRECTED, conditions={"record_id": record_id()})
    # Rows without a person type are leftovers unless they are a parked empty car.
    df = df.where(F.col("ptype").isNotNull() | (F.col("parked_empty_car") == 1))

    pursued, records = F.col("pursuit_driver") == 1, F.count(F.lit(1))
    if dealt is not None:
        df = propagate_within(df, "par", pursued, "vnumber", aggs={"records": records})
    else:  # several branches read it
        df = propagate(stage(df), "par", pursued, "vnumber", aggs={"records": (records, F.sum)})
    # The long id is made of columns that nothing above changes, so it is not stored or moved.
    df = df.withColumn("record_id", record_id())
    df = fill_zero(df, ["pursuit_driver", "pursuit_crash", "pursuit_tag", "is_officer"])
    df = df.withColumn(
        "city_code",
        recode_values(F.nullif(F.col("city"), F.lit(0)), names.CITY_CODE_REPAIRS),
    )
    df = df.withColumns({"pcat_v": person_category(), "pcat_p": pursuit_role()})
    if city_codes is not None:
        df = df.join(city_codes, "city_code", "left")
    return df.select(
        F.col("par").alias("incident"), "record_id", "pursuit_crash", "pursuit_tag",
        F.col("co_char").alias("county_name"), F.col("county").alias("county_code"),
        *(["city_name"] if city_codes is not None else []), "city_code",
        F.col("y").alias("latitude"), F.col("x").alias("longitude"),
        F.col("crash_dt").alias("date"), "year", F.col("accmon").alias("mo_num"),
        (F.col("pforms") + F.col("nmforms")).alias("persons"),
        F.col("vforms").alias("vehicles"), F.col("nmforms").alias("nonmotorists"),
        F.col("numfatal").alias("fatals"), "records",
        F.col("investjur").alias("agency_invest_name"), F.col("repjur").alias("agency_report_num"),
        F.col("repag_long").alias("agency_report_name"),
        F.col("flagged_unit").alias("vnum_p"), F.col("vnumber").alias("vnum"),
        "numoccs", "spuse", "pursuit_driver", "pcat_p", "pcat_v",
        injury_label("injury").alias("injury"), "age", sex_label("sex").alias("sex"),
        "hispanic", F.col("race_me").alias("race"), "is_officer", "parked_empty_car",
        "ptype", "pnumber", F.col("injury").alias("injury_type"), "diedscene", "death_dt",
    )


def minimal(records: DataFrame, pursuit_only: bool = False) -> DataFrame:
    """The columns needed for linkage, optionally only the tagged records."""
    df = records.where(F.col("pursuit_tag") == 1) if pursuit_only else records
    return df.select(*MIN_COLUMNS)
