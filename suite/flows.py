"""End-to-end flows: source preparation, linkage and the report's tables.

The agencies' file layouts are filled from line items (persons) and orders (crashes).
"""

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlab import names, schemas
from incidentlab.flows import (
    agency_linkage, crowd_linkage, national, newspaper, report, state_crash, state_person,
)
from incidentlab.io import read_table, shared_folder, stage
from incidentlab.rsem import first_match

from .aggregation import SQL_ROLLUP, incidents
from .base import (
    DEPENDS, POLICY, SQL_AFTER, SQL_PURSUIT, SQL_VEHICULAR, SQL_VIEWS, cases, deaths, fatalities, persons, query,
    source_a, source_b, source_c,
)
from .reporting import COUNT, LONG_SQL, _cells

# --- raw lines -------------------------------------------------------------------------

SQL_VIEWS["lines"] = """
SELECT l_orderkey AS case_id, l_linenumber AS unit, (l_partkey * 100000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS person,
  CAST(l_quantity AS INT) AS q, CAST(round(l_discount * 100) AS INT) AS d, CAST(round(l_tax * 100) AS INT) AS x,
  date, year(date) AS year, priority, order_status, county_code, county, city, custkey
FROM lineitem JOIN cases ON l_orderkey = case_id
"""
DEPENDS["lines"] = ["cases"]


def lines(t):
    """The persons of a crash file; staged, as the agencies' inputs are finished files."""
    c = F.col
    raw = t.lineitem.select(
        c("l_orderkey").alias("case_id"), c("l_linenumber").alias("unit"),
        ((c("l_partkey") * 100000 + c("l_suppkey")) * 100 + c("l_quantity").cast("long")).alias("person"),
        c("l_quantity").cast("int").alias("q"),
        F.round(c("l_discount") * 100).cast("int").alias("d"),
        F.round(c("l_tax") * 100).cast("int").alias("x"),
    )
    case = cases(t).select("case_id", "date", "priority", "order_status", "county_code", "county", "city", "custkey")
    return stage(raw.join(case, "case_id").withColumn("year", F.year("date")))


# --- source A: state person files --------------------------------------------------------

SQL_VIEWS["pa"] = """
WITH raw AS (
  SELECT *, CAST(case_id AS VARCHAR) AS par, NULLIF(q % 11, 0) AS ptype, CASE WHEN x = 8 THEN 5 ELSE 0 END AS spuse,
    CASE WHEN d >= 8 THEN 6 ELSE 1 END AS regowner, d % 3 AS numoccs,
    CAST(q = 37 OR coalesce(CASE WHEN d = 7 THEN 37 END, 0) = 37 AS INT) AS pursuit_driver,
    CAST(priority = '1-URGENT' OR (priority = '2-HIGH' AND order_status = 'F') AS INT) AS pursuit_crash,
    CAST(q = 16 OR d = 4 AS INT) AS is_officer FROM lines),
flagged AS (SELECT *, CAST(pursuit_driver = 1 OR pursuit_crash = 1 AS INT) AS pursuit_tag,
    CAST(regowner = 6 AND numoccs = 0 AS INT) AS parked_empty_car FROM raw),
kept AS (SELECT * FROM flagged WHERE ptype IS NOT NULL OR parked_empty_car = 1),
units AS (SELECT DISTINCT par, unit FROM kept WHERE pursuit_driver = 1),
more AS (SELECT *, (SELECT min(u.unit) FROM units u WHERE u.par = kept.par) AS vnum_p,
    EXISTS (SELECT 1 FROM units u WHERE u.par = kept.par AND u.unit = kept.unit) AS in_unit,
    count(*) OVER (PARTITION BY par) AS records FROM kept)
SELECT par AS incident, par || 'v' || unit || 'p' || coalesce(CAST(NULLIF(person, 0) AS VARCHAR), '999') AS record_id, pursuit_tag, pursuit_driver,
  pursuit_crash, county_code, CASE city WHEN 'BUILDING' THEN 2550 WHEN 'MACHINERY' THEN 170 WHEN 'HOUSEHOLD' THEN NULL ELSE 300 END AS city_code, date,
  CASE WHEN pursuit_tag = 0 THEN 'Not tagged pursuit' WHEN (ptype IN (1, 2, 5, 9) AND spuse = 5) OR is_officer = 1 THEN 'Officer'
    WHEN ptype = 1 AND pursuit_driver = 1 THEN 'Subject' WHEN ptype IN (2, 9) AND in_unit THEN 'Passenger'
    WHEN parked_empty_car = 1 THEN 'Parked empty car' ELSE 'Bystander' END AS pcat_p,
  CASE WHEN (ptype IN (1, 2, 5, 9) AND spuse = 5) OR is_officer = 1 THEN 'Officer' WHEN ptype = 1 THEN 'Driver' WHEN ptype IN (2, 9) THEN 'Passenger'
    WHEN ptype = 3 THEN 'Parked car occupant' WHEN ptype IN (5, 6, 7, 12, 13, 19) THEN 'Non-motorist'
    WHEN parked_empty_car = 1 THEN 'Parked empty car' ELSE 'Other' END AS pcat_v,
  unit AS vnum, vnum_p, numoccs, parked_empty_car, NULLIF(q % 10, 0) AS age,
  CASE x % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'O/U' END AS sex,
  CASE q % 6 WHEN 4 THEN 'fatal' WHEN 3 THEN 'serious injury' WHEN 0 THEN 'no injury' WHEN 1 THEN 'minor injury' WHEN 2 THEN 'minor injury'
    WHEN 5 THEN 'minor injury' END AS injury,
  custkey % 4 + custkey % 3 AS persons, custkey % 5 AS vehicles, records, custkey % 6 AS fatals FROM more
"""
DEPENDS["pa"] = ["lines"]

A_OUT = [c for c in state_person.MIN_COLUMNS if c not in ("race", "hispanic")]


def state_persons(t, rows=None, rules=None, supplement=None):
    c = F.col
    empty = F.lit(None).cast("int")
    rows = lines(t) if rows is None else rows
    columns = [
        c("case_id").cast("string").alias("par"), "year", c("date").alias("crash_dt"),
        F.month("date").alias("accmon"), F.dayofmonth("date").alias("accday"),
        c("unit").alias("vnumber"), F.nullif("person", F.lit(0)).alias("pnumber"),
        F.nullif(c("q") % 11, F.lit(0)).alias("ptype"),
        F.when(c("x") == 8, 5).otherwise(0).alias("spuse"), (c("d") % 3).alias("numoccs"),
        F.when(c("d") >= 8, 6).otherwise(1).alias("regowner"),
        c("q").alias("drf1"), F.when(c("d") == 7, 37).alias("drf2"), F.when(c("d") == 4, 16).alias("drf3"),
        empty.alias("drf4"),
        first_match([(c("city") == "BUILDING", 111), (c("city") == "MACHINERY", 171),
                     (c("city") == "HOUSEHOLD", 0)], 300).alias("city"),
        c("county_code").alias("county"), c("county").alias("co_char"),
        F.lit(-120.0).alias("x"), F.lit(47.0).alias("y"),
        (c("custkey") % 4).alias("pforms"), (c("custkey") % 5).alias("vforms"),
        (c("custkey") % 3).alias("nmforms"), (c("custkey") % 6).alias("numfatal"),
        (c("q") % 6).alias("injury"), F.nullif(c("q") % 10, F.lit(0)).alias("age"),
        (c("x") % 3 + 1).alias("sex"), F.lit("x").alias("race_me"), F.lit("x").alias("hispanic"),
        F.lit(1).alias("repjur"), F.lit("x").alias("investjur"), F.lit("x").alias("repag_long"),
        F.lit(0).alias("diedscene"), c("date").alias("death_dt"),
    ]
    base = rows.select(*columns)
    # A finished file like the others.
    crash = stage(rows.select(
        c("case_id").cast("string").alias("par"), "year",
        F.when(c("priority") == "1-URGENT", 20).alias("cf1"), empty.alias("cf2"), F.lit(0).alias("cf3"),
        empty.alias("crf1"),
        F.when((c("priority") == "2-HIGH") & (c("order_status") == "F"), 20).alias("crf2"), empty.alias("crf3"),
    ).distinct())
    # Early years carry month and day as text.
    early = base.where(c("year") < 1999).withColumns(
        {"accmon": c("accmon").cast("string"), "accday": c("accday").cast("string")}
    )
    late = base.where(c("year") >= 1999)
    extra = None
    if supplement is not None:
        # The condition is one on the case, so it holds for all of its rows or for none.
        extra = stage(rows.where(supplement).select(*columns).join(crash, ["par", "year"]).withColumn(
            "par", F.concat(F.lit("X"), "par")))
    return state_person.build([early, late], factors=crash, extra=extra, fixes=rules)


PA_OUT = ", ".join(A_OUT)


@query(f"""
SELECT {PA_OUT} FROM (SELECT * REPLACE (
  CASE WHEN CAST(incident AS BIGINT) % 7 = 0 THEN persons + 3 ELSE persons END AS persons,
  CASE WHEN CAST(incident AS BIGINT) % 14 = 0 THEN NULL WHEN CAST(incident AS BIGINT) % 7 = 0 THEN vehicles + 1 ELSE vehicles END AS vehicles) FROM pa)
UNION ALL SELECT {PA_OUT} FROM (SELECT * REPLACE ('X' || incident AS incident, 'X' || record_id AS record_id) FROM pa
  WHERE CAST(incident AS BIGINT) % 5 = 0)
""", "pa")
def flow_state_person_corrected(t):
    """Counts corrected by incident, and a transcribed supplement in the layout of the files."""
    rows = lines(t)
    ids = rows.select(F.col("case_id").alias("n")).distinct().withColumn("par", F.col("n").cast("string"))

    def rule(number, where, column, op, value):
        return ids.where(where).select("par", F.lit(number).alias("rule"), F.lit(column).alias("column_name"),
                                       F.lit(op).alias("op"), F.lit(value).alias("value"))

    rules = reduce(DataFrame.unionByName, [
        rule(1, F.col("n") % 7 == 0, "pforms", "add", "3"), rule(2, F.col("n") % 7 == 0, "vforms", "add", "1"),
        rule(3, F.col("n") % 14 == 0, "vforms", "missing", None),
    ])
    return state_person.minimal(
        state_persons(t, rows, rules=stage(rules), supplement=F.col("case_id") % 5 == 0)).select(*A_OUT)


@query(f"SELECT {PA_OUT} FROM pa", "pa")
def flow_state_person(t):
    return state_person.minimal(state_persons(t)).select(*A_OUT)


# --- source B: state crash extract -------------------------------------------------------

SQL_VIEWS["pb"] = """
WITH kept AS (
  SELECT *, CAST(case_id AS VARCHAR) AS inc, CASE q % 3 WHEN 0 THEN 'MV Driver' WHEN 1 THEN 'MV Passenger' ELSE 'Pedestrian' END AS person_type,
    CAST(q = 37 OR d = 9 AS INT) AS pursuit_driver, CAST(d = 10 AS INT) AS parked_empty_car,
    CASE WHEN x = 8 THEN 'Yes' WHEN x < 7 THEN 'No' END AS officer,
    CASE q % 7 WHEN 0 THEN 'Dead at Scene' WHEN 1 THEN 'Died in Hospital' WHEN 2 THEN 'Suspected Serious Injury' WHEN 3 THEN 'Possible Injury'
      WHEN 4 THEN 'No Apparent Injury' WHEN 5 THEN 'Non-Incapacitating' END AS injury_type
  FROM lines WHERE NOT (custkey % 5 = 0 AND priority = '5-LOW')),
numbered AS (SELECT *, row_number() OVER (PARTITION BY inc, unit ORDER BY person_type, person) AS person_no FROM kept),
units AS (SELECT DISTINCT inc, unit FROM numbered WHERE pursuit_driver = 1),
more AS (SELECT *, (SELECT min(u.unit) FROM units u WHERE u.inc = numbered.inc) AS vnum_p,
    EXISTS (SELECT 1 FROM units u WHERE u.inc = numbered.inc AND u.unit = numbered.unit) AS in_unit,
    count(*) OVER (PARTITION BY inc) AS records,
    CAST(sum(1 - parked_empty_car) OVER (PARTITION BY inc) AS BIGINT) AS persons FROM numbered)
SELECT inc AS incident, inc || 'u' || unit || 'p' || person_no AS record_id, CASE WHEN vnum_p IS NULL THEN 0 ELSE 1 END AS pursuit_tag, pursuit_driver,
  n_nationkey AS county_code, city_code, date,
  CASE WHEN vnum_p IS NULL THEN 'Not tagged pursuit' WHEN officer = 'Yes' THEN 'Officer' WHEN pursuit_driver = 1 THEN 'Subject'
    WHEN person_type = 'MV Passenger' AND in_unit THEN 'Passenger' WHEN parked_empty_car = 1 THEN 'Parked empty car' ELSE 'Bystander' END AS pcat_p,
  CASE WHEN officer = 'Yes' THEN 'Officer' WHEN parked_empty_car = 1 THEN 'Parked empty car' WHEN person_type = 'MV Driver' THEN 'Driver'
    WHEN person_type = 'MV Passenger' THEN 'Passenger' ELSE 'Non-motorist' END AS pcat_v,
  unit AS vnum, vnum_p, parked_empty_car, CASE WHEN d = 5 THEN NULL ELSE NULLIF(q % 10, 0) END AS age,
  CASE x % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'O/U' END AS sex,
  CASE WHEN q % 7 IN (0, 1) THEN 'fatal' WHEN q % 7 = 2 THEN 'serious injury' WHEN q % 7 IN (3, 5) THEN 'minor injury' WHEN q % 7 = 4 THEN 'no injury'
    ELSE 'Unknown' END AS injury,
  persons, custkey % 5 + 1 AS vehicles, records, custkey % 6 AS fatals
FROM more JOIN nation ON n_name = county
LEFT JOIN (SELECT DISTINCT c_mktsegment AS seg, length(c_mktsegment) AS city_code FROM customer WHERE c_mktsegment <> 'FURNITURE') ON seg = city
"""
DEPENDS["pb"] = ["lines"]


def state_crashes(t, rows=None, rules=None):
    c = F.col
    rows = lines(t) if rows is None else rows
    raw = rows.select(
        c("case_id").cast("string").alias("Collision Report Number"), c("unit").alias("Unit Number"),
        first_match([(c("q") % 3 == 0, "MV Driver"), (c("q") % 3 == 1, "MV Passenger")], "Pedestrian").alias("Involved Person Type"),
        first_match([
            (c("q") % 7 == 0, "Dead at Scene"), (c("q") % 7 == 1, "Died in Hospital"),
            (c("q") % 7 == 2, "Suspected Serious Injury"), (c("q") % 7 == 3, "Possible Injury"),
            (c("q") % 7 == 4, "No Apparent Injury"), (c("q") % 7 == 5, "Non-Incapacitating"),
        ]).alias("Injury Type"),
        F.when(c("q") == 37, "Fleeing pursuit").alias("MV Driver Miscellaneous Action 1"),
        F.lit("None").alias("MV Driver Miscellaneous Action 2"),
        F.when(c("d") == 9, "In pursuit").otherwise("Other").alias("MV Driver Miscellaneous Action 3"),
        F.when(c("d") == 10, "Unoccupied, Parked").when(c("d") > 2, "Going Straight").alias("Vehicle Action 1"),
        F.when(c("d") != 5, F.nullif(c("q") % 10, F.lit(0))).alias("Age"),
        first_match([(c("x") % 3 == 0, "Male"), (c("x") % 3 == 1, "Female")]).alias("Gender"),
        c("date").alias("Date"), c("year").alias("Year"), F.month("date").alias("Month Number"),
        c("city").alias("City Name"), c("county").alias("County Name"),
        (900000 + 1000.0 * c("county_code")).alias("State Plane X"),
        (300000 + 1000.0 * c("unit")).alias("State Plane Y"),
        (c("custkey") % 6).alias("Number of Fatalities"),
        (c("custkey") % 5 + 1).alias("Number of Motor Vehicles Involved"),
        F.when(c("x") == 8, "Yes").when(c("x") < 7, "No").alias("On Duty Indicator"),
        "person",
    )
    excluded = rows.where((c("custkey") % 5 == 0) & (c("priority") == "5-LOW")).select(
        c("case_id").cast("string").alias("Collision Report Number")
    )
    counties = t.nation.select(c("n_name").alias("county_name"), c("n_nationkey").alias("county_code"))
    cities = t.customer.where(c("c_mktsegment") != "FURNITURE").select(
        c("c_mktsegment").alias("city_name"), F.length("c_mktsegment").alias("city_code")
    ).distinct()
    return state_crash.build(raw, ["person"], excluded, rules, counties, cities)


PB_OUT = ", ".join(state_crash.MIN_COLUMNS)


@query(f"""
SELECT {PB_OUT} FROM (SELECT * REPLACE (
  CASE WHEN CAST(incident AS BIGINT) % 4 = 0 THEN 'M' WHEN CAST(incident AS BIGINT) % 4 = 1 AND age IN (2, 5) THEN 'F' ELSE sex END AS sex,
  CASE WHEN CAST(incident AS BIGINT) % 6 = 1 AND vnum IN (3, 4) THEN 'Bystander' ELSE pcat_p END AS pcat_p,
  CASE WHEN CAST(incident AS BIGINT) % 10 = 3 AND record_id = incident || 'u1p1' THEN 'Officer' ELSE pcat_v END AS pcat_v,
  CASE WHEN CAST(incident AS BIGINT) % 9 = 2 THEN persons + 3 ELSE persons END AS persons) FROM pb)
""", "pb")
def flow_state_crash_corrected(t):
    """The agency's records with corrections by incident, by age, by record and by a list of units."""
    rows = lines(t)
    ids = rows.select(F.col("case_id").alias("n")).distinct().withColumn("incident", F.col("n").cast("string"))
    n, none = F.col("n"), F.lit(None)

    def rule(number, where, column, op, value, age=none, record=none, units=none):
        return ids.where(where).select(
            "incident", F.lit(number).alias("rule"), F.lit(column).alias("column_name"), F.lit(op).alias("op"),
            F.lit(value).alias("value"), age.cast("array<int>").alias("age"), record.cast("string").alias("record_id"),
            units.cast("array<int>").alias("vnum"))

    rules = reduce(DataFrame.unionByName, [
        rule(1, n % 4 == 0, "sex", "set", "M"),
        rule(2, n % 4 == 1, "sex", "set", "F", age=F.array(F.lit(2), F.lit(5))),
        rule(3, n % 6 == 1, "pcat_p", "set", "Bystander", units=F.array(F.lit(3), F.lit(4))),
        rule(4, n % 10 == 3, "pcat_v", "set", "Officer", record=F.concat("incident", F.lit("u1p1"))),
        rule(5, n % 9 == 2, "persons", "add", "3"),
    ])
    return state_crash.minimal(state_crashes(t, rows, rules=stage(rules)))


@query(f"SELECT {PB_OUT} FROM pb", "pb")
def flow_state_crash(t):
    return state_crash.minimal(state_crashes(t))


# --- A to B linkage ----------------------------------------------------------------------

SAME = "a.incident = b.incident AND a.county_code = b.county_code AND a.age IS NOT DISTINCT FROM b.age AND a.sex = b.sex"
SIDE = ["record_id", "pcat_v", "pcat_p", "injury", "parked_empty_car", "city_code", "fatals", "vnum", "vnum_p", "date", "persons", "vehicles", "records"]
_BOTH = "coalesce(a.incident, b.incident) AS incident, coalesce(a.county_code, b.county_code) AS county_code, coalesce(a.age, b.age) AS age, coalesce(a.sex, b.sex) AS sex, " + ", ".join(
    f"{s}.{c} AS {c}_{s}" for s in "ab" for c in SIDE
)


def _pairs_sql(left: str, right: str) -> str:
    """Both sides numbered inside the keys, in the order of their ids."""
    nth = "row_number() OVER (PARTITION BY incident, county_code, age, sex ORDER BY record_id) AS nth"
    return (f"SELECT {_BOTH} FROM (SELECT *, {nth} FROM {left}) a FULL JOIN (SELECT *, {nth} FROM {right}) b "
            f"ON {SAME} AND a.nth = b.nth")


SQL_VIEWS["consensus"] = f"""
WITH ta AS (SELECT * FROM pa WHERE pursuit_tag = 1), tb AS (SELECT * FROM pb WHERE pursuit_tag = 1),
first_pass AS ({_pairs_sql("ta", "tb")}),
touched AS (SELECT DISTINCT incident FROM first_pass WHERE record_id_a IS NOT NULL AND record_id_b IS NOT NULL),
left_a AS (SELECT * FROM ta WHERE record_id IN (SELECT record_id_a FROM first_pass WHERE record_id_b IS NULL)),
pool_b AS (SELECT * FROM pb WHERE incident IN (SELECT incident FROM first_pass) AND incident NOT IN (SELECT incident FROM touched)),
second_pass AS ({_pairs_sql("left_a", "pool_b")}),
every AS (SELECT *, 2 AS status_a, 2 AS status_b FROM first_pass WHERE record_id_a IS NOT NULL AND record_id_b IS NOT NULL
  UNION ALL SELECT *, CASE WHEN record_id_a IS NULL THEN 0 ELSE 2 END, CASE WHEN record_id_b IS NULL THEN 0 ELSE 1 END FROM second_pass
  UNION ALL SELECT *, 0, 2 FROM first_pass WHERE record_id_a IS NULL AND incident IN (SELECT incident FROM touched))
SELECT incident, record_id_a, record_id_b, coalesce('a:' || record_id_a, 'b:' || record_id_b) AS record_id_w, status_a, status_b, county_code, age, sex,
  {", ".join(f"coalesce({c}_a, {c}_b) AS {c}_w" for c in SIDE[1:9])}, coalesce(date_a, date_b) AS date,
  {", ".join(f"greatest({c}_a, {c}_b) AS {c}_w" for c in SIDE[10:])} FROM every
"""
DEPENDS["consensus"] = ["pa", "pb"]
W_OUT = ["incident", "record_id_a", "record_id_b", "status_a", "status_b", "county_code", "age", "sex",
         *[f"{c}_w" for c in SIDE[1:9]], "date", *[f"{c}_w" for c in SIDE[10:]]]


def agency_links(t):
    rows = lines(t)
    return agency_linkage.build(
        stage(state_person.minimal(state_persons(t, rows))),
        stage(state_crash.minimal(state_crashes(t, rows))),
    )


@query(f"SELECT {', '.join(W_OUT)} FROM consensus", "consensus")
def flow_agency_linkage(t):
    return agency_links(t).records.select(*W_OUT)


@query("""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY incident ORDER BY record_id_w) AS i FROM consensus WHERE parked_empty_car_w <> 1 AND injury_w = 'fatal'),
two AS (SELECT incident, max(CASE WHEN i = 1 THEN pcat_p_w END) AS fatal_pcat_p1_w, max(CASE WHEN i = 2 THEN pcat_p_w END) AS fatal_pcat_p2_w,
  max(CASE WHEN i = 1 THEN vnum_w END) AS fatal_vnum1_w, max(CASE WHEN i = 2 THEN vnum_w END) AS fatal_vnum2_w FROM f WHERE i <= 2 GROUP BY incident),
h AS (SELECT * FROM consensus QUALIFY row_number() OVER (PARTITION BY incident ORDER BY record_id_w) = 1)
SELECT h.incident, s.status_a, s.status_b, s.records_w, year(h.date) AS year, month(h.date) AS month, h.date, h.county_code, h.city_code_w, h.persons_w,
  h.vehicles_w, h.fatals_w, h.vnum_p_w, fatal_pcat_p1_w, fatal_pcat_p2_w, fatal_vnum1_w, fatal_vnum2_w
FROM h JOIN (SELECT incident, max(status_a) AS status_a, max(status_b) AS status_b, count(*) AS records_w FROM consensus GROUP BY incident) s USING (incident)
LEFT JOIN two USING (incident)
""", "consensus")
def flow_agency_incidents(t):
    return agency_links(t).incidents


# --- crowd source to agencies --------------------------------------------------------------

CROWD_KEYS = ["date", "county_code", "age", "city"]
C_SAME = "c.date = p.date AND c.county_code = p.county_code AND c.age IS NOT DISTINCT FROM p.age AND c.city = p.city"



def _crowd_tier(name: str, tier: int, left: str) -> str:
    nth = "row_number() OVER (PARTITION BY date, county_code, age, city ORDER BY c_id) AS nth"
    return (f"{name} AS (SELECT c.c_id, c.date, c.county_code, c.age, c.city, p.tier, p.id, p.persons, p.status_a, p.status_b "
            f"FROM (SELECT *, {nth} FROM sc {left}) c JOIN pools p ON {C_SAME} AND p.tier = {tier} AND p.nth = c.nth)")


SQL_VIEWS["crowd_linked"] = f"""
WITH pools AS (SELECT *, row_number() OVER (PARTITION BY tier, date, county_code, age, city ORDER BY id) AS nth FROM (
  SELECT 1 AS tier, a_id AS id, date, county_code, age, city, persons, 2 AS status_a, a_id % 3 AS status_b FROM sa WHERE tag = 1
  UNION ALL SELECT 2, a_id, date, county_code, age, city, persons, 1, 1 FROM sa WHERE tag = 0
  UNION ALL SELECT 3, b_id, date, county_code, age, city, persons, 0, 1 FROM sb WHERE tag = 0)),
{_crowd_tier("h1", 1, "")},
{_crowd_tier("h2", 2, "WHERE c_id NOT IN (SELECT c_id FROM h1)")},
{_crowd_tier("h3", 3, "WHERE c_id NOT IN (SELECT c_id FROM h1 UNION ALL SELECT c_id FROM h2)")},
hit AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3),
every AS (
  SELECT c_id, date, county_code, age, city, CASE tier WHEN 1 THEN 'FE+W' WHEN 2 THEN 'FE+untagged-WTSC' ELSE 'FE+untagged-WSDOT' END AS inclusion, id, persons,
    status_a, status_b, 2 AS status_fe FROM hit
  UNION ALL SELECT c_id, date, county_code, age, city, 'FE-only', NULL, NULL, 0, 0, 2 FROM sc WHERE c_id NOT IN (SELECT c_id FROM hit)
  UNION ALL SELECT NULL, date, county_code, age, city, 'WTSC-only', a_id, persons, 2, a_id % 3, 0 FROM sa p WHERE tag = 1
    AND a_id NOT IN (SELECT id FROM h1))
SELECT *, CASE WHEN status_fe = 2 AND status_a < 2 AND status_b < 2 THEN 'FE-only' WHEN status_fe = 0 AND (status_a = 2 OR status_b = 2) THEN 'W-only'
  WHEN status_fe = 2 THEN 'FE+W' ELSE 'Other' END AS tag_status, CAST(status_a <> 0 OR status_b <> 0 AS INT) AS status_w FROM every
"""
DEPENDS["crowd_linked"] = ["sa", "sb", "sc"]


def _pool(df, record, *extra):
    text = F.lit("x")
    return df.select(
        *CROWD_KEYS, F.col(record).alias("record_id"), F.col(record).alias("incident"),
        text.alias("pcat_v"), text.alias("pcat_p"), "persons", F.lit(1).alias("vehicles"),
        F.lit(1).alias("fatals"), F.lit(1).alias("records"), F.lit(1).alias("city_code"), *extra,
    )


def crowd_links(t):
    a, b = stage(source_a(t)), stage(source_b(t))
    crowd = stage(source_c(t)).select(
        F.col("c_id").alias("fe_id"), *CROWD_KEYS, F.col("c_id").alias("incident_fe"),
        F.lit("Active pursuit").alias("vpursuit_fe"), F.lit(2).alias("status_fe"),
        F.lit(2).alias("city_code_fe"), F.lit("x").alias("pcat_p_fe"),
    )
    agency = _pool(a.where(F.col("tag") == 1), "a_id", F.lit(2).alias("status_a"), (F.col("a_id") % 3).cast("int").alias("status_b"))
    return crowd_linkage.fatalities(
        crowd, agency, _pool(a.where(F.col("tag") == 0), "a_id"),
        _pool(b.where(F.col("tag") == 0), "b_id"), CROWD_KEYS,
    )


@query("""
SELECT c_id, inclusion, CAST(id AS VARCHAR) AS match_id, persons, status_a, status_b, status_fe, tag_status, status_w,
  CAST(coalesce(id, c_id) AS VARCHAR) AS incident_id FROM crowd_linked
""", "crowd_linked")
def flow_crowd_linkage(t):
    return crowd_links(t).select(
        F.col("fe_id").alias("c_id"), "inclusion", "match_id", "persons", "status_a", "status_b",
        "status_fe", "tag_status", "status_w", "incident_id",
    )


SQL_VIEWS["crowd_members"] = """
WITH found AS (SELECT id, min_by(inclusion, c_id) AS inclusion, min(c_id) AS c_id FROM crowd_linked WHERE inclusion LIKE 'FE+untagged%' GROUP BY id),
ma AS (SELECT rec_id, case_id AS id, person_age AS age, victim, {nth} FROM persons WHERE cod <> 'Vehicle' AND case_id IN (SELECT id FROM found)),
mb AS (SELECT rec_id, case_id AS id, person_age AS age, victim, {nth} FROM persons WHERE cod <> 'Vehicle' AND unit <= 4 AND case_id IN (SELECT id FROM found)),
x AS (SELECT coalesce(ma.id, mb.id) AS id, ma.rec_id AS rec_a, mb.rec_id AS rec_b FROM ma FULL JOIN mb ON ma.id = mb.id AND ma.age IS NOT DISTINCT FROM mb.age
  AND ma.victim IS NOT DISTINCT FROM mb.victim AND ma.nth = mb.nth)
SELECT x.id AS incident, rec_a, rec_b, inclusion, c_id FROM x JOIN found USING (id)
""".replace("{nth}", "row_number() OVER (PARTITION BY case_id, person_age, victim ORDER BY rec_id) AS nth")
DEPENDS["crowd_members"] = ["persons", "crowd_linked"]


def crowd_members(t, linked):
    people = persons(t).select(
        "rec_id", F.col("case_id").alias("incident"), F.col("person_age").alias("age"), "victim", "unit",
        F.when(F.col("cod") == "Vehicle", "fatal").when(F.col("cod").isNotNull(), "no injury").alias("injury"),
    ).withColumnRenamed("rec_id", "record_id")
    return crowd_linkage.nonfatal_members(
        linked, people.drop("unit"), people.where(F.col("unit") <= 4).drop("unit"), ["age", "victim"]
    )


@query("SELECT * FROM crowd_members", "crowd_members")
def flow_crowd_members(t):
    return crowd_members(t, stage(crowd_links(t))).select(
        "incident", F.col("record_id_a").alias("rec_a"), F.col("record_id_b").alias("rec_b"),
        "inclusion", F.col("fe_id").alias("c_id"))


@query("""
SELECT inclusion, status_w2, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT inclusion, status_w AS status_w2 FROM crowd_linked UNION ALL SELECT inclusion, 1 FROM crowd_members) GROUP BY ALL
""", "crowd_linked crowd_members")
def flow_crowd_all_records(t):
    """Deaths and surviving members together, by how they were found."""
    fatal = stage(crowd_links(t))
    both = crowd_linkage.all_records(fatal, crowd_members(t, fatal))
    return both.groupBy("inclusion", "status_w2").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH d AS (SELECT case_id AS fe_id, custkey AS incident_fe, date, county_code, age, CASE age % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'O/U' END AS sex,
    CASE WHEN city <> 'FURNITURE' THEN length(city) END AS city_code_fe, vpursuit AS vpursuit_fe, priority AS pcat_p_fe,
    row_number() OVER (PARTITION BY custkey ORDER BY case_id) AS i FROM cases WHERE vpursuit <> 'Reviewed not related'),
g AS (SELECT incident_fe, CAST(count(*) AS BIGINT) AS persons_fe, max(CASE WHEN i = 1 THEN pcat_p_fe END) AS pcat_p1_fe,
  max(CASE WHEN i = 2 THEN pcat_p_fe END) AS pcat_p2_fe FROM d GROUP BY 1)
SELECT d.* EXCLUDE (i), persons_fe, pcat_p1_fe, pcat_p2_fe FROM d JOIN g USING (incident_fe)
""", "cases")
def flow_crowd_prepare(t):
    c = F.col
    deaths_ = cases(t).select(
        c("case_id").alias("fe_id"), c("custkey").alias("incident_num"), "date", "age", "city", "county", "vpursuit",
        c("vpursuit").alias("pursuit_type"), c("priority").alias("victim"), F.lit("x").alias("cod"), F.lit("y").alias("injury"),
        first_match([(c("age") % 3 == 0, "Male"), (c("age") % 3 == 1, "Female")]).alias("gender"),
    )
    cities = t.customer.where(c("c_mktsegment") != "FURNITURE").select(
        c("c_mktsegment").alias("city_name"), F.length("c_mktsegment").alias("city_code")).distinct()
    counties = t.nation.select(c("n_name").alias("county_name"), c("n_nationkey").alias("county_code"))
    crowd = stage(crowd_linkage.prepare(deaths_, cities, counties))
    return crowd_linkage.with_incident_summary(crowd).select(
        "fe_id", "incident_fe", "date", "county_code", "age", "sex", "city_code_fe", "vpursuit_fe", "pcat_p_fe",
        "persons_fe", "pcat_p1_fe", "pcat_p2_fe")


# --- national files ------------------------------------------------------------------------

SQL_VIEWS["national"] = """
WITH p AS (SELECT *, CASE q % 13 WHEN 12 THEN 99 ELSE NULLIF(q % 13, 0) END AS per_typ, NULLIF(x, 7) AS sev FROM lines WHERE county_code < 15),
v AS (SELECT year, case_id, unit, max(CASE WHEN x = 8 THEN 5 ELSE 0 END) AS spec_use,
    CASE WHEN year < 1999 THEN max(CAST(q = 37 AS INT)) ELSE max(CAST(d = 9 AS INT)) END AS pursuit_driver FROM lines WHERE county_code < 15 GROUP BY year, case_id, unit),
c AS (SELECT case_id, CASE WHEN year(date) < 1999 THEN CASE WHEN priority = '1-URGENT' THEN 1 WHEN order_status = 'O' THEN NULL ELSE 0 END
    ELSE CASE WHEN priority = '2-HIGH' THEN 1 ELSE 0 END END AS pursuit_crash FROM cases WHERE county_code < 15)
SELECT p.year, p.case_id AS "ST_CASE", p.unit AS "VEH_NO", p.person AS "PER_NO", p.date,
  CASE WHEN sev = 4 THEN p.date END AS death_date, per_typ AS "PER_TYP", p.custkey % 9 AS "RACE", v.spec_use AS "SPEC_USE",
  v.pursuit_driver, c.pursuit_crash, n_name AS county_name,
  CASE WHEN per_typ = 99 THEN 'Unknown' WHEN per_typ IN (1, 2, 9) AND spec_use = 5 THEN 'Officer' WHEN per_typ = 1 AND pursuit_driver = 1 THEN 'Subject'
    WHEN per_typ IN (2, 9) AND pursuit_driver = 1 THEN 'Passenger' WHEN pursuit_driver = 1 OR pursuit_crash = 1 THEN 'Bystander' END AS victim
FROM p JOIN v USING (year, case_id, unit) JOIN c USING (case_id) JOIN nation ON n_nationkey = county_code
"""
DEPENDS["national"] = ["lines"]
NATIONAL_OUT = ["year", "ST_CASE", "VEH_NO", "PER_NO", "date", "death_date", "PER_TYP", "RACE", "SPEC_USE",
                "pursuit_driver", "pursuit_crash", "county_name", "victim"]


def national_persons(t):
    c = F.col
    state = F.when(c("county_code") < 15, "Here").otherwise("Elsewhere").alias("STATENAME")
    rows = lines(t)
    person = rows.select(
        "year", c("case_id").alias("ST_CASE"), c("unit").alias("VEH_NO"), c("person").alias("PER_NO"), state,
        F.month("date").alias("MONTH"), F.dayofmonth("date").alias("DAY"),
        F.month("date").alias("DEATH_MO"), F.dayofmonth("date").alias("DEATH_DA"),
        F.nullif("x", F.lit(7)).alias("INJ_SEV"),
        F.when(c("q") % 13 == 12, 99).otherwise(F.nullif(c("q") % 13, F.lit(0))).alias("PER_TYP"),
        F.lit(0).alias("STR_VEH"), c("q").alias("AGE"), F.lit("x").alias("SEXNAME"), F.lit(0).alias("HISPANIC"),
        (c("custkey") % 9).alias("RACE"),
    )
    vehicle = rows.groupBy("year", c("case_id").alias("ST_CASE"), c("unit").alias("VEH_NO"), state).agg(
        F.max(F.when(c("x") == 8, 5).otherwise(0)).alias("SPEC_USE"),
        F.max(F.when(c("q") == 37, 37).otherwise(0)).alias("DR_SF1"),
        *[F.lit(0).alias(f"DR_SF{i}") for i in (2, 3, 4)],
    )
    crash = stage(cases(t)).select(
        F.year("date").alias("year"), c("case_id").alias("ST_CASE"), state,
        *[F.lit(1).alias(n) for n in ("VE_TOTAL", "VE_FORMS", "PEDS", "PERSONS", "CITY", "FATALS")],
        c("county_code").alias("COUNTY"), F.lit("x").alias("RUR_URBNAME"),
        F.lit(47.0).alias("LATITUDE"), F.lit(-120.0).alias("LONGITUD"),
        F.when(c("priority") == "1-URGENT", 20).otherwise(0).alias("CF1"), F.lit(0).alias("CF2"),
        F.when(c("order_status") != "O", 0).alias("CF3"),
        "priority",
    )
    # One row per line, so a vehicle can have several factors.
    driver = rows.select(
        "year", c("case_id").alias("ST_CASE"), c("unit").alias("VEH_NO"), state,
        F.when(c("d") == 9, "Police Pursuing this Driver").otherwise("None").alias("DRIVERRFNAME"),
    )
    factor = crash.select(
        "year", "ST_CASE", "STATENAME",
        F.when(c("priority") == "2-HIGH", "Police Pursuit Involved").otherwise("None").alias("CRASHRFNAME"),
    )
    early, middle, late = c("year") < 1997, (c("year") >= 1997) & (c("year") < 1999), c("year") >= 1999
    race = person.select("year", "ST_CASE", "VEH_NO", "PER_NO", "STATENAME", "RACE")
    factors = ["DR_SF1", "DR_SF2", "DR_SF3", "DR_SF4"]
    # One table per kind of file, as a reader with the columns of all years gives them.
    counties = t.nation.select(c("n_name").alias("county_name"), c("n_nationkey").alias("county_code"))

    def lacking(df, columns, years):
        return df.withColumns({x: F.when(~years, F.col(x)) for x in columns})

    files = national.Files(
        lacking(person, ["RACE"], ~early), lacking(vehicle, factors, late),
        lacking(crash.drop("priority"), ["CF1", "CF2", "CF3"], late), race.where(middle | late),
        driver.where(late), factor.where(late),
    )
    return national.build_by_year(
        files, national.Eras(1997, 1999), "Here", counties)


@query(f'SELECT {", ".join(chr(34) + c + chr(34) for c in NATIONAL_OUT)} FROM national WHERE pursuit_crash = 1 OR pursuit_driver = 1', "national")
def flow_national(t):
    return national.flagged(national_persons(t)).select(*NATIONAL_OUT)


# --- newspaper list --------------------------------------------------------------------------

SQL_VIEWS["coded"] = """
SELECT case_id AS fe_id, date, county, year(date) AS year, day(date) AS day, month(date) AS mo_num,
  CASE WHEN order_status = 'F' THEN vpursuit END AS vpursuit_draft,
  CASE WHEN coalesce(regexp_matches(agency, 'Patrol|Marshals'), false) THEN 'He fled in a car' ELSE 'At home' END AS description,
  CASE WHEN age = 3 THEN 'Vehicle' ELSE 'Gunshot' END AS cod,
  CASE WHEN age > 6 THEN 'terminated pursuit' END AS final FROM cases
"""
DEPENDS["coded"] = ["cases"]

SQL_VIEWS["news"] = """
SELECT case_id, county, year(date) AS year, month(date) AS mo, day(date) AS day, CASE city WHEN 'BUILDING' THEN 'Lynnwood' ELSE city END AS city_name
FROM cases WHERE district = 'ASIA'
"""
DEPENDS["news"] = ["cases"]


def news_cases(t):
    c = F.col
    raw = cases(t).select(
        c("case_id").alias("Seq"), F.when(c("district") == "ASIA", "XX").otherwise("YY").alias("ST"),
        c("county").alias("County"), F.when(c("city") == "BUILDING", "Lynwood").otherwise(c("city")).alias("City"),
        F.year("date").alias("Year"), F.month("date").alias("Mo"), F.dayofmonth("date").alias("Date"),
    )
    return newspaper.prepare(raw, "XX").withColumnRenamed("case_id", "news_id")


@query("""
SELECT case_id, county AS county_name, CASE city WHEN 'BUILDING' THEN 'Lynnwood' ELSE city END AS city_name, date, n_nationkey AS county_code,
  CAST(length(city) AS INT) AS city_code
FROM cases JOIN nation ON n_name = county WHERE district = 'ASIA'
""", "cases")
def scan_declared_schemas(t):
    """Agency files written as CSV and read with their declared schemas."""
    c = F.col
    raw = cases(t).select(
        c("case_id").alias("Seq"), F.when(c("district") == "ASIA", "XX").otherwise("YY").alias("ST"), c("county").alias("County"),
        F.when(c("city") == "BUILDING", "Lynwood").otherwise(c("city")).alias("City"), F.year("date").alias("Year"),
        F.month("date").alias("Mo"), F.dayofmonth("date").alias("Date"), F.lit(1).alias("Deaths"), F.lit(2).alias("People"),
        F.lit(1).alias("Vehs"), F.lit("x").alias("Fleeing driver"), F.lit("y").alias("Pursuing agency"),
    )
    counties = t.nation.select(c("n_name").alias("county_name"), c("n_nationkey").alias("county_code"))
    cities = t.customer.select(c("c_mktsegment").alias("city_name"), F.length("c_mktsegment").alias("city_code")).distinct()
    cities = cities.withColumn("city_name", F.when(c("city_name") == "BUILDING", "Lynnwood").otherwise(c("city_name")))
    folder, read = shared_folder(t.spark), {}
    for name, df, schema in (("news", raw, schemas.NEWSPAPER), ("counties", counties, schemas.COUNTY_CODES),
                             ("cities", cities, schemas.CITY_CODES)):
        df.write.option("header", True).csv(f"{folder}/{name}.csv")
        read[name] = read_table(t.spark, f"{folder}/{name}.csv", schema)
    return newspaper.prepare(read["news"], "XX", read["counties"], read["cities"]).select(
        c("case_id").cast("long").alias("case_id"), "county_name", "city_name", "date", "county_code", "city_code")


@query("""
WITH k AS (SELECT *, CASE WHEN vpursuit_draft IS NOT NULL THEN 1 WHEN regexp_matches(description, 'vehicle|car|crash|speed|chase|pursuit|flee|fled') THEN 2
    WHEN cod = 'Vehicle' THEN 3 END AS pursuit_tag FROM coded),
f AS (SELECT *, CASE coalesce(final, vpursuit_draft) WHEN 'terminated pursuit' THEN 'Terminated Pursuit' WHEN 'Active pursuit' THEN 'Active Pursuit'
    WHEN 'Involved pursuit' THEN 'Involved Pursuit' WHEN 'Attempted stop' THEN 'Attempted Stop' WHEN 'Reviewed not related' THEN 'Reviewed Not Related' END AS vpursuit
  FROM k WHERE pursuit_tag IS NOT NULL),
d AS (SELECT *, CASE WHEN coalesce(regexp_matches(vpursuit, 'Active|Terminated'), false) THEN 'Pursuit' ELSE vpursuit END AS pursuit_type FROM f)
SELECT fe_id, pursuit_tag, vpursuit, pursuit_type, n.case_id AS news_id, CASE WHEN n.case_id IS NULL THEN 0 ELSE 1 END AS newspaper,
  coalesce(d.county, n.county) AS county, n.city_name
FROM (SELECT *, row_number() OVER (PARTITION BY county, date ORDER BY fe_id) AS nth FROM d WHERE pursuit_type <> 'Reviewed Not Related') d
FULL JOIN (SELECT *, row_number() OVER (PARTITION BY county, year, mo, day ORDER BY case_id) AS nth FROM news) n
  ON d.county = n.county AND d.year = n.year AND d.mo_num = n.mo AND d.day = n.day AND d.nth = n.nth
""", "coded news")
def flow_newspaper(t):
    c = F.col
    people = cases(t).select(
        c("case_id").alias("fe_id"), "date", "county", F.year("date").alias("year"),
        F.dayofmonth("date").alias("day"), F.date_format("date", "MMM").alias("month"), "age",
        F.when(c("order_status") == "F", c("vpursuit")).alias("vpursuit_draft"),
        F.when(c("agency").rlike("Patrol|Marshals"), "He fled in a car").otherwise("At home").alias("description"),
        F.when(c("age") == 3, "Vehicle").otherwise("Gunshot").alias("cod"),
    )
    coded = people.select(
        "fe_id", "vpursuit_draft", F.when(c("age") > 6, "terminated pursuit").alias("vpursuit_final"),
        F.lit("x").alias("victim_final"), F.lit("u").alias("url_info"), F.lit(None).cast("string").alias("url_additional"),
    )
    final = newspaper.apply_coding(newspaper.tag_candidates(people), coded)
    return newspaper.compare(final, news_cases(t), case_id="news_id").select(
        "fe_id", "pursuit_tag", "vpursuit", "pursuit_type", "news_id", "newspaper", "county", "city_name"
    )


# --- report tables ------------------------------------------------------------------------

PCT = "format('{{:.{d}f}}%', round(100 * n / (SELECT sum(n) FROM g), {d}))"


def _share_sql(dim: str, d: int = 1) -> str:
    return f"""
SELECT {dim}, n AS "Number", {PCT.format(d=d)} AS "Percent" FROM g
UNION ALL SELECT 'Total', CAST(sum(n) AS BIGINT), format('{{:.{d}f}}%', 100.0) FROM g"""


@query(f"""
WITH {SQL_ROLLUP}, g AS (SELECT CASE WHEN incident_type = 'All other fatalities' THEN 'Vehicle not involved' ELSE incident_type END AS incident_type,
  {COUNT} AS n FROM incidents GROUP BY 1) {_share_sql("incident_type")}
""", "fatalities")
def report_incident_types(t):
    return report.incident_type_table(incidents(t))


@query(f"""
WITH g AS (SELECT CASE WHEN incident_type = 'Pursuit vehicular fatality' THEN incident_type WHEN cod IN ('Gunshot', 'Taser') THEN cod
  WHEN coalesce(regexp_matches(cod, 'Asphyx'), false) THEN 'Asphyxiated/Restrained' ELSE 'All other causes' END AS cod_cat, {COUNT} AS n FROM fatalities GROUP BY 1)
{_share_sql("cod_cat")}
""", "fatalities")
def report_causes(t):
    return report.cause_table(fatalities(t))


@query(f"""
WITH g AS (SELECT victim, {COUNT} AS n FROM fatalities WHERE {SQL_VEHICULAR} GROUP BY 1) {_share_sql("victim", 0)}
""", "fatalities")
def report_victims(t):
    return report.victim_table(fatalities(t))


def _victims(alias: str, value: str) -> str:
    return f"CAST(CASE WHEN count(victim) = count(*) THEN count(*) FILTER (victim = '{value}') END AS BIGINT) AS \"{alias}\""


@query(f"""
SELECT policy_period, {_victims("Subjects", "Subject")}, {_victims("Bystanders", "Bystander")}, {_victims("Passengers", "Passenger")},
  {_victims("Officers", "Officer")}, {COUNT} AS "Total" FROM fatalities WHERE {SQL_AFTER} GROUP BY policy_period
""", "fatalities")
def report_period_victims(t):
    return report.period_victims(fatalities(t), "after")


ABBREVIATED = ("replace(replace(replace(replace(agency, 'Washington State Patrol', 'WSP'), 'Washington', 'WA'), "
               "'County Sheriff''s Office', 'Co SO'), 'Police Department', 'PD')")


@query(f"""
SELECT name, date, victim, county, {ABBREVIATED} AS agency, district AS "LD", incident_type AS "incident type", vpursuit AS "code detail",
  url_click AS "link to article" FROM fatalities WHERE {SQL_PURSUIT}
""", "fatalities")
def report_fatalities_export(t):
    return report.fatalities_export(fatalities(t))


@query("""
SELECT name, date, victim, county, replace(replace(replace(replace(agency, 'Washington', 'WA'), 'County Sheriff''s Office', 'Co SO'),
  'Police Department', 'PD'), 'State Patrol', 'SP') AS agency, url_click AS "link to article" FROM fatalities WHERE regexp_matches(incident_type, 'stop')
""", "fatalities")
def report_stops_export(t):
    return report.stops_export(fatalities(t))


@query(f"""
WITH {SQL_ROLLUP} SELECT {ABBREVIATED} AS "Agency", date AS "Date", district AS "LD", fatalities AS "Fatalities", pbo_killed AS "P/O/B killed",
  pb_injured AS "P/B injured" FROM incidents WHERE {SQL_PURSUIT}
""", "fatalities")
def report_incidents_export(t):
    return report.incidents_export(incidents(t))


INCIDENT_MEASURES = [
    ("incidents", "true", False),
    ("pursuit_veh_fatalities", "regexp_matches(incident_type, 'vehicular')", False),
    ("after_pursuit_homicides", "regexp_matches(incident_type, 'homicide')", False),
    ("after_pursuit_suicides", "regexp_matches(incident_type, 'suicide')", False),
]


@query(f"""
WITH {SQL_ROLLUP}, {LONG_SQL.replace("rec_id, ", "").replace("victim, ", "").replace("FROM fatalities", "FROM incidents")},
wide AS (SELECT agency, min(agency_type) AS agency_type, {", ".join(_cells(*m) for m in INCIDENT_MEASURES)} FROM long GROUP BY agency)
SELECT wide.*, {", ".join(f"coalesce({m[0]}_pre, 0) + coalesce({m[0]}_reform, 0) + coalesce({m[0]}_rollback, 0) AS {m[0]}_tot" for m in INCIDENT_MEASURES)},
  'ORI' || n_nationkey AS "ORI", n_nationkey * 1000 AS population, CASE WHEN n_name IS NOT NULL THEN 'yes' END AS accredited
FROM wide LEFT JOIN nation ON agency = n_name || ' County Sheriff''s Office'
""", "fatalities")
def report_agency_incidents(t):
    agencies = t.nation.select(
        F.concat("n_name", F.lit(" County Sheriff's Office")).alias("agency"),
        F.concat(F.lit("ORI"), F.col("n_nationkey").cast("string")).alias("ORI"),
        (F.col("n_nationkey") * 1000).alias("population"), F.lit("yes").alias("accredited"),
    )
    return report.agency_period_matrix(report.agency_cases(incidents(t)), agencies, "incidents")


@query(f"""
WITH {SQL_ROLLUP} SELECT {COUNT} AS incidents, CAST(count(*) FILTER (inci_mapmult = 'mult') AS BIGINT) AS multiple FROM incidents
WHERE regexp_matches(incident_type, 'stop')
""", "fatalities")
def report_stops_summary(t):
    return report.stops_summary(incidents(t))


@query(f"""
SELECT count(*) AS cases, count(*) FILTER (not_kbp <> 0) AS excluded, count(*) FILTER (not_kbp = 0) AS included,
  (SELECT count(DISTINCT case_id) FROM fatalities) AS incidents FROM deaths
""", "fatalities")
def report_exclusions(t):
    return report.exclusion_summary(deaths(t), incidents(t))


_CODINGS = ", ".join(f"'{v}'" for v in names.CODING_LEVELS)


@query(f"""
SELECT CASE WHEN vpursuit IN ({_CODINGS}) THEN vpursuit END AS vpursuit,
  {", ".join(f"CAST(count(*) FILTER (incident_type = '{v}') AS BIGINT) AS {chr(34)}{v}{chr(34)}" for v in names.INCIDENT_TYPE_LEVELS)}
FROM fatalities GROUP BY 1
""", "fatalities")
def report_coding_crosstab(t):
    return report.coding_crosstab(fatalities(t))


@query(f"""
SELECT policy_period, "Number", "Number" / sum("Number") FILTER (policy_period <> 'Total') OVER () AS "Percent" FROM (
  SELECT policy_period, {COUNT} AS "Number" FROM fatalities GROUP BY 1 UNION ALL SELECT 'Total', {COUNT} FROM fatalities)
""", "fatalities")
def report_periods(t):
    return report.period_shares(fatalities(t)).withColumn("Percent", F.round("Percent", 12))


@query(f"""
WITH {SQL_ROLLUP}, f AS (SELECT *, CASE WHEN month(date) >= 8 THEN year(date) ELSE year(date) - 1 END AS y FROM incidents WHERE {SQL_PURSUIT} AND date > DATE '1995-07-31'),
grid AS (SELECT DISTINCT y, v FROM f, (SELECT unnest(['After pursuit suicide', 'After pursuit homicide', 'Pursuit vehicular fatality']) AS v)),
n AS (SELECT y, incident_type, count(*) AS c FROM f GROUP BY ALL)
SELECT grid.y || '-' || (grid.y + 1) AS leg_year, v AS incident_type, CAST(coalesce(c, 0) AS BIGINT) AS "Number",
  CAST(sum(coalesce(c, 0)) OVER (PARTITION BY grid.y) AS BIGINT) AS "Total" FROM grid LEFT JOIN n ON n.y = grid.y AND n.incident_type = v
""", "fatalities")
def report_incidents_by_fiscal_year(t):
    return report.legislative_grid(
        incidents(t).drop("leg_year"), "pursuit", "incident_type", names.PURSUIT_TYPE_LEVELS, F.lit(date(1995, 7, 31))
    )
