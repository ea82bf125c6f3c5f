"""The test tables seen as incident records, once in Spark and once in SQL.

An order is an incident and a line item is a person record. Both definitions of a view
stand next to each other; queries build on them.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from incidentlab.periods import Policy
from incidentlab.rsem import first_match

POLICY = Policy(date(1995, 1, 1), date(1998, 7, 1), date(2000, 6, 1), date(2001, 8, 1))

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SCHEMAS: dict[str, StructType] = {}  # a table's schema is read from its files once


@dataclass(frozen=True)
class Tables:
    spark: SparkSession
    sf_dir: str

    def __getattr__(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        if path not in SCHEMAS:
            SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(SCHEMAS[path]).parquet(path)


def name_folder(spark: SparkSession) -> None:
    """Name a folder for stored stages in a session that has none, if it is one process."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().isDefined()
    if not named and context.master.partition("[")[0] == "local":
        context.setCheckpointDir(tempfile.mkdtemp(prefix="incidentlab-"))


def query(sql: str | None = None, ctes: str = "") -> Callable:
    """Register a query under its function name. ``ctes`` names the views, in order, that
    are put in front of the SQL."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            name_folder(spark)
            return fn(Tables(spark, sf_dir))

        QUERIES[fn.__name__] = run
        if sql is not None:
            views = ",\n".join(f"{v} AS ({SQL_VIEWS[v].strip()})" for v in _closure(ctes.split()))
            body = sql.strip()
            if views:
                body = (
                    f"WITH {views},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {views}\n{body}"
                )
            ORACLES[fn.__name__] = body
        return fn

    return register


def _closure(wanted: list[str]) -> list[str]:
    """The wanted views preceded by the views they read."""
    out: list[str] = []
    for name in wanted:
        for dep in [*_closure(DEPENDS.get(name, [])), name]:
            if dep not in out:
                out.append(dep)
    return out


SQL_VIEWS: dict[str, str] = {}
DEPENDS = {"persons": ["cases"], "deaths": ["persons"], "fatalities": ["deaths"],
           "sa": ["cases"], "sb": ["cases"], "sc": ["cases"]}

# --- cases: one row per order --------------------------------------------------------------

SQL_VIEWS["cases"] = """
SELECT o_orderkey AS case_id, CAST(o_orderdate AS DATE) AS date,
  o_orderpriority AS priority, o_orderstatus AS order_status,
  n_name AS county, n_nationkey AS county_code, r_name AS district, c_mktsegment AS city,
  c_name AS name, c_custkey AS custkey,
  NULLIF(CAST(floor(o_totalprice) AS BIGINT) % 10, 0) AS age,
  CASE o_orderpriority
    WHEN '1-URGENT' THEN CASE WHEN o_orderstatus = 'F' THEN 'Active pursuit' ELSE 'Terminated pursuit' END
    WHEN '2-HIGH' THEN 'Involved pursuit' WHEN '3-MEDIUM' THEN 'Involved pursuit'
    WHEN '4-NOT SPECIFIED' THEN 'Attempted stop'
    ELSE CASE WHEN o_orderstatus = 'P' THEN 'Vehicle accident' WHEN o_orderstatus = 'F' THEN 'Reviewed not related' END
  END AS vpursuit,
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END AS suicide,
  concat_ws(', ', n_name || ' County Sheriff''s Office',
    CASE WHEN o_orderstatus = 'F' THEN c_mktsegment || ' Police Department' END,
    CASE WHEN o_orderstatus = 'P' THEN 'Washington State Patrol' END,
    CASE WHEN o_custkey % 5 = 0 THEN r_name || ' Tribal Police' END,
    CASE WHEN o_custkey % 7 = 0 THEN 'Department of Corrections' END,
    CASE WHEN o_custkey % 11 = 0 THEN 'US Marshals' END) AS agency,
  CASE WHEN o_orderstatus IN ('F', 'P') OR o_custkey % 5 = 0 OR o_custkey % 7 = 0 OR o_custkey % 11 = 0
         THEN 'Multiple agencies'
       WHEN c_mktsegment = 'MACHINERY' THEN 'State Police'
       WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Other agency'
       WHEN c_mktsegment = 'BUILDING' THEN NULL
       ELSE 'County SO' END AS agency_type
FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


def cases(t: Tables) -> DataFrame:
    c = F.col
    status, cust = c("o_orderstatus"), c("o_custkey")
    places = t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey")).join(
        t.region, c("n_regionkey") == c("r_regionkey")
    )
    several = status.isin("F", "P") | (cust % 5 == 0) | (cust % 7 == 0) | (cust % 11 == 0)
    return t.orders.join(places, c("o_custkey") == c("c_custkey")).select(
        c("o_orderkey").alias("case_id"),
        c("o_orderdate").cast("date").alias("date"),
        c("o_orderpriority").alias("priority"),
        status.alias("order_status"),
        c("n_name").alias("county"),
        c("n_nationkey").alias("county_code"),
        c("r_name").alias("district"),
        c("c_mktsegment").alias("city"),
        c("c_name").alias("name"),
        c("c_custkey").alias("custkey"),
        F.nullif(F.floor("o_totalprice") % 10, F.lit(0)).alias("age"),
        first_match([
            ((c("o_orderpriority") == "1-URGENT") & (status == "F"), "Active pursuit"),
            (c("o_orderpriority") == "1-URGENT", "Terminated pursuit"),
            (c("o_orderpriority").isin("2-HIGH", "3-MEDIUM"), "Involved pursuit"),
            (c("o_orderpriority") == "4-NOT SPECIFIED", "Attempted stop"),
            (status == "P", "Vehicle accident"),
            (status == "F", "Reviewed not related"),
        ]).alias("vpursuit"),
        (c("o_orderpriority") == "3-MEDIUM").cast("int").alias("suicide"),
        F.concat_ws(
            ", ",
            F.concat("n_name", F.lit(" County Sheriff's Office")),
            F.when(status == "F", F.concat("c_mktsegment", F.lit(" Police Department"))),
            F.when(status == "P", "Washington State Patrol"),
            F.when(cust % 5 == 0, F.concat("r_name", F.lit(" Tribal Police"))),
            F.when(cust % 7 == 0, "Department of Corrections"),
            F.when(cust % 11 == 0, "US Marshals"),
        ).alias("agency"),
        first_match([
            (several, "Multiple agencies"),
            (c("c_mktsegment") == "MACHINERY", "State Police"),
            (c("c_mktsegment") == "HOUSEHOLD", "Other agency"),
            (c("c_mktsegment") == "BUILDING", F.lit(None).cast("string")),
        ], "County SO").alias("agency_type"),
    )


# --- persons: one row per line item --------------------------------------------------------

SQL_VIEWS["persons"] = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rec_id,
  l_orderkey AS case_id, l_linenumber AS unit, l_partkey AS partkey, l_suppkey AS suppkey,
  CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'Subject' WHEN 'AO' THEN 'Bystander'
    WHEN 'NF' THEN 'Passenger' WHEN 'NO' THEN 'Officer' WHEN 'RF' THEN 'Subject' END AS victim,
  CASE l_linenumber WHEN 1 THEN 'Subject' WHEN 2 THEN 'Passenger, Bystander' WHEN 3 THEN 'Officer'
    WHEN 4 THEN 'Bystander' WHEN 5 THEN 'None' END AS injury,
  CASE CAST(round(l_tax * 100) AS INT) WHEN 0 THEN 'Vehicle' WHEN 1 THEN 'Gunshot' WHEN 2 THEN 'Gunshot'
    WHEN 3 THEN 'Taser' WHEN 4 THEN 'Asphyxiated/Restrained' WHEN 5 THEN 'Vehicle' WHEN 6 THEN NULL
    ELSE 'Undetermined' END AS cod,
  CASE WHEN l_quantity >= 49 THEN 1 ELSE 0 END AS not_kbp,
  NULLIF(CAST(l_quantity AS BIGINT) % 10, 0) AS person_age
FROM lineitem
"""


def persons(t: Tables) -> DataFrame:
    c = F.col
    kind = F.concat("l_returnflag", "l_linestatus")
    line, tax = c("l_linenumber"), F.round(c("l_tax") * 100).cast("int")
    return t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("rec_id"),
        c("l_orderkey").alias("case_id"),
        line.alias("unit"),
        c("l_partkey").alias("partkey"),
        c("l_suppkey").alias("suppkey"),
        first_match([
            (kind.isin("AF", "RF"), "Subject"), (kind == "AO", "Bystander"),
            (kind == "NF", "Passenger"), (kind == "NO", "Officer"),
        ]).alias("victim"),
        first_match([
            (line == 1, "Subject"), (line == 2, "Passenger, Bystander"), (line == 3, "Officer"),
            (line == 4, "Bystander"), (line == 5, "None"),
        ]).alias("injury"),
        first_match([
            (tax.isin(0, 5), "Vehicle"), (tax.isin(1, 2), "Gunshot"), (tax == 3, "Taser"),
            (tax == 4, "Asphyxiated/Restrained"), (tax == 6, F.lit(None).cast("string")),
        ], "Undetermined").alias("cod"),
        (c("l_quantity") >= 49).cast("int").alias("not_kbp"),
        F.nullif(c("l_quantity").cast("long") % 10, F.lit(0)).alias("person_age"),
    )


# --- deaths: persons with their case, in the layout of the report's input ------------------

SQL_VIEWS["deaths"] = """
SELECT rec_id, case_id, unit, victim, injury, cod, not_kbp, person_age, date, year(date) AS year,
  strftime(date, '%b') AS month, day(date) AS day, priority, order_status, county, county_code, district,
  city, name, custkey, vpursuit, suicide, agency, agency_type,
  45.5 + county_code / 10.0 AS latitude, -124.0 + custkey % 100 / 20.0 AS longitude,
  'https://example.org/' || rec_id AS url_click
FROM persons JOIN cases USING (case_id)
"""


def deaths(t: Tables) -> DataFrame:
    c = F.col
    return persons(t).join(cases(t), "case_id").withColumns({
        "year": F.year("date"),
        "month": F.date_format("date", "MMM"),
        "day": F.dayofmonth("date"),
        "latitude": 45.5 + c("county_code") / 10.0,
        "longitude": -124.0 + c("custkey") % 100 / 20.0,
        "url_click": F.concat(F.lit("https://example.org/"), "rec_id"),
    })


# --- fatalities: deaths after classification -----------------------------------------------

SQL_INCIDENT_TYPE = """
CASE WHEN coalesce(regexp_matches(vpursuit, 'Active|Terminated'), false) THEN 'Pursuit vehicular fatality'
     WHEN coalesce(regexp_matches(vpursuit, 'Involved'), false) AND suicide = 1 THEN 'After pursuit suicide'
     WHEN coalesce(regexp_matches(vpursuit, 'Involved'), false) THEN 'After pursuit homicide'
     WHEN vpursuit = 'Attempted stop' THEN 'Attempted stop fatality'
     WHEN coalesce(regexp_matches(vpursuit, 'accident'), false) THEN 'Vehicle accident fatality'
     ELSE 'All other fatalities' END
"""

SQL_PERIOD = """
CASE WHEN date < DATE '1998-07-01' THEN 'pre' WHEN date < DATE '2000-06-01' THEN 'reform' ELSE 'rollback' END
"""

SQL_TYPE_RANK = """
CASE incident_type WHEN 'After pursuit homicide' THEN 1 WHEN 'Pursuit vehicular fatality' THEN 2
  WHEN 'After pursuit suicide' THEN 3 WHEN 'Attempted stop fatality' THEN 4
  WHEN 'Vehicle accident fatality' THEN 5 WHEN 'All other fatalities' THEN 6 END
"""

SQL_VIEWS["fatalities"] = f"""
SELECT * REPLACE (CASE WHEN agency_type = 'State Police' THEN 'WSP'
    WHEN coalesce(regexp_matches(agency_type, 'Other'), false) THEN 'Other' ELSE agency_type END AS agency_type),
  {SQL_INCIDENT_TYPE} AS incident_type, {SQL_PERIOD} AS policy_period, case_id AS incident_num
FROM deaths WHERE not_kbp = 0
"""

# Subset conditions of the report, on incident_type.
SQL_PURSUIT = "regexp_matches(incident_type, 'Pursuit|pursuit')"
SQL_VEHICULAR = f"({SQL_PURSUIT} AND NOT regexp_matches(incident_type, 'After'))"
SQL_AFTER = f"({SQL_PURSUIT} AND regexp_matches(incident_type, 'After'))"


def fatalities(t: Tables) -> DataFrame:
    from incidentlab.flows.report import classify_deaths

    described = deaths(t).withColumn("description", F.col("name"))
    return classify_deaths(described, POLICY).withColumn("incident_num", F.col("case_id"))


# --- three overlapping sources at the case grain, for linkage ------------------------------

LINK_KEYS = ["date", "district", "age"]

SQL_VIEWS["sa"] = """
SELECT case_id AS a_id, date, district, age, county_code, city, custkey % 4 AS persons,
  CASE WHEN order_status = 'F' THEN 1 ELSE 0 END AS tag
FROM cases WHERE priority <> '5-LOW'
"""
SQL_VIEWS["sb"] = """
SELECT case_id + 1000000000 AS b_id, date, district, age, county_code, city,
  NULLIF(custkey % 5, 0) AS persons, CASE WHEN order_status = 'F' THEN 1 ELSE 0 END AS tag
FROM cases WHERE priority <> '1-URGENT'
"""
SQL_VIEWS["sc"] = """
SELECT case_id + 2000000000 AS c_id, date, district, age, county_code, city, custkey % 7 AS persons
FROM cases WHERE order_status <> 'O'
"""


def source_a(t: Tables) -> DataFrame:
    return cases(t).where(F.col("priority") != "5-LOW").select(
        F.col("case_id").alias("a_id"), "date", "district", "age", "county_code", "city",
        (F.col("custkey") % 4).alias("persons"),
        (F.col("order_status") == "F").cast("int").alias("tag"),
    )


def source_b(t: Tables) -> DataFrame:
    return cases(t).where(F.col("priority") != "1-URGENT").select(
        (F.col("case_id") + 1000000000).alias("b_id"), "date", "district", "age", "county_code",
        "city", F.nullif(F.col("custkey") % 5, F.lit(0)).alias("persons"),
        (F.col("order_status") == "F").cast("int").alias("tag"),
    )


def source_c(t: Tables) -> DataFrame:
    return cases(t).where(F.col("order_status") != "O").select(
        (F.col("case_id") + 2000000000).alias("c_id"), "date", "district", "age", "county_code",
        "city", (F.col("custkey") % 7).alias("persons"),
    )
