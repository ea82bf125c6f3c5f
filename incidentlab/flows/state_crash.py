"""State crash extract (source B): no person numbers, no crash-level pursuit flag,
coordinates in state-plane feet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import names
from ..clean import any_match, exclude, fill_zero, recode_values
from ..corrections import correct
from ..geo import project_points
from ..io import stage
from ..rollup import firsts, person_ids, propagate, propagate_within, together
from ..rsem import first_match, matches

ID, UNIT = "Collision Report Number", "Unit Number"
ACTIONS = [f"MV Driver Miscellaneous Action {i}" for i in (1, 2, 3)]

MIN_COLUMNS = [
    "incident", "record_id", "pursuit_tag", "pursuit_driver", "county_code", "city_code", "date",
    "pcat_p", "pcat_v", "vnum", "vnum_p", "parked_empty_car", "age", "sex", "injury", "persons",
    "vehicles", "records", "fatals",
]


#: Columns that corrections may touch.
CORRECTED = ["sex", "pcat_v", "pcat_p", "persons"]


def injury_label(text: str) -> Column:
    """Order matters: "Non-incapacitating" must be seen before "No"."""
    # The tests below and their order decide the result.
    return first_match([
        (matches(text, "Dead|Died"), "fatal"),
        (matches(text, "Serious"), "serious injury"),
        (matches(text, "Possible|Minor|Non"), "minor injury"),
        (matches(text, "No"), "no injury"),
    ], "Unknown")


def sex_label(text: str) -> Column:
    # The tests below and their order decide the result.
    return first_match([(F.col(text) == "Male", "M"), (F.col(text) == "Female", "F")], "O/U")


def person_category() -> Column:
    # The tests below and their order decide the result.
    return first_match([
        (F.col("officer") == "Yes", "Officer"),
        (F.col("parked_empty_car") == 1, "Parked empty car"),
        (F.col("person_type") == "MV Driver", "Driver"),
        (F.col("person_type") == "MV Passenger", "Passenger"),
    ], "Non-motorist")


def pursuit_role() -> Column:
    # The tests below and their order decide the result.
    return first_match([
        (F.col("pursuit_tag") == 0, "Not tagged pursuit"),
        (F.col("officer") == "Yes", "Officer"),
        (F.col("pursuit_driver") == 1, "Subject"),
        ((F.col("person_type") == "MV Passenger") & (F.col("in_flagged_unit") == 1), "Passenger"),
        (F.col("parked_empty_car") == 1, "Parked empty car"),
        (F.col("pursuit_tag") == 1, "Bystander"),
    ])


def build(
    raw: DataFrame, tie: Sequence[str], excluded: DataFrame | None = None,
    fixes: DataFrame | None = None, county_codes: DataFrame | None = None,
    city_codes: DataFrame | None = None,
) -> DataFrame:
    """All person records. ``tie`` lists the columns that, after the person type, order
    persons inside a unit; ``excluded`` holds keys of rows to drop; ``fixes`` are
    rules of ``corrections`` by incident and, if they say so, record, unit (or several units) and
    age; they are applied to the finished columns."""
    # The keys as a table of its own, so that Spark sees how few they are.
    df = exclude(raw, stage(excluded.distinct())) if excluded is not None else raw
    df = df.withColumns({
        "pursuit_driver": any_match(ACTIONS, "pursuit"),
        "parked_empty_car": matches("Vehicle Action 1", "Unoccupied").cast("int"),
    })
    df = stage(df)  # the sizes, the numbering and every branch of propagate read it
    order, pursued = ["Involved Person Type", *tie], F.col("pursuit_driver") == 1
    records, persons = F.count(F.lit(1)), F.count_if(F.col("parked_empty_car") == 0)
    plane = {"x": "State Plane X", "y": "State Plane Y"}
    dealt = together(df, ID)
    # The point is that of the first person of the first unit; a missing unit comes last.
    if dealt is not None:
        df = propagate_within(
            person_ids(dealt, ID, UNIT, order, dealt=True), ID, pursued, UNIT,
            aggs={"records": records, "persons": persons, "point": firsts([UNIT, *order], plane)})
    else:
        first_unit = F.struct(F.col(UNIT).isNull(), F.col(UNIT))
        df = propagate(
            person_ids(df, ID, UNIT, order), ID, pursued, UNIT, source=df,
            aggs={"records": (records, F.sum), "persons": (persons, F.sum),
                  "point": (firsts(order, plane), lambda c: F.min_by(c, first_unit))})
    df = df.withColumn("pursuit_tag", (F.col("flagged_units") > 0).cast("int"))
    df = project_points(
        df.withColumns({"px": F.col("point.x"), "py": F.col("point.y")}), "px", "py"
    )
    df = df.withColumnsRenamed({
        "Involved Person Type": "person_type", "On Duty Indicator": "officer",
        "County Name": "county_name",
    }).withColumn("city_name", recode_values("City Name", names.CITY_SPELLINGS))
    for codes, key in ((county_codes, "county_name"), (city_codes, "city_name")):
        if codes is not None:
            df = df.join(codes, key, "left")
    df = df.select(
        F.col(ID).alias("incident"), "record_id", "pursuit_tag", "pursuit_driver", "county_name",
        *(["county_code"] if county_codes is not None else []), "city_name",
        *(["city_code"] if city_codes is not None else []),
        "latitude", "longitude", F.col("Date").alias("date"), F.col("Year").alias("year"),
        F.col("Month Number").alias("mo_num"), "persons",
        F.col("Number of Motor Vehicles Involved").alias("vehicles"),
        F.col("Number of Fatalities").alias("fatals"), "records",
        F.col("flagged_unit").alias("vnum_p"), F.col(UNIT).alias("vnum"), "in_flagged_unit",
        "person_type", "officer", "parked_empty_car", F.col("Age").alias("age"),
        sex_label("Gender").alias("sex"), F.col("Injury Type").alias("injury_type"),
        injury_label("Injury Type").alias("injury"),
    )
    df = fill_zero(df, ["pursuit_driver"])
    df = df.withColumns({"pcat_v": person_category(), "pcat_p": pursuit_role()})
    if fixes is None:
        return df
    return correct(df, fixes, "incident", CORRECTED, conditions=["record_id", "vnum", "age"])


def minimal(records: DataFrame, pursuit_only: bool = False) -> DataFrame:
    df = records.where(F.col("pursuit_tag") == 1) if pursuit_only else records
    return df.select(*MIN_COLUMNS)
