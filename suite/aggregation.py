"""Aggregates, roll-ups, numbering and ordering."""

from pyspark.sql import functions as F

from incidentlab import names, tables
from incidentlab.flows.report import build_incidents, number_incidents
from incidentlab.geo import markers
from incidentlab.io import stage
from incidentlab.ordering import number_within
from incidentlab.rollup import attach_group, first_by, nth_by, person_ids, with_previous
from incidentlab.rsem import level_rank, strict_count

from .base import SQL_TYPE_RANK, cases, deaths, fatalities, persons, query

# Percent text: one decimal, halves away from zero, as format_number prints it.
SQL_PCT = "format('{{:.1f}}%', round(100 * {x}, 1))"


@query("SELECT county, count(*) AS n FROM cases GROUP BY county", "cases")
def agg_count(t):
    return tables.count_by(cases(t), "county", out="n")


@query("""
SELECT case_id, CAST(sum(CASE WHEN coalesce(regexp_matches(victim, 'Subject'), false) THEN 1 ELSE 0 END) AS BIGINT) AS subjects,
  CAST(CASE WHEN count(victim) = count(*) THEN sum(CASE WHEN victim = 'Officer' THEN 1 ELSE 0 END) END AS BIGINT) AS officers,
  CAST(sum(CASE WHEN cod = 'Gunshot' THEN 1 ELSE 0 END) AS BIGINT) AS shot FROM persons GROUP BY case_id
""", "persons")
def agg_conditional(t):
    return persons(t).groupBy("case_id").agg(
        F.count_if(F.coalesce(F.col("victim").rlike("Subject"), F.lit(False))).alias("subjects"),
        strict_count(F.col("victim") == "Officer").alias("officers"),
        F.count_if(F.col("cod") == "Gunshot").alias("shot"),
    )


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY person_age NULLS LAST, rec_id) AS i FROM persons)
SELECT case_id, max(CASE WHEN i = 1 THEN victim END) AS victim1, max(CASE WHEN i = 2 THEN victim END) AS victim2,
  max(CASE WHEN i = 1 THEN unit END) AS unit1, max(CASE WHEN i = 2 THEN unit END) AS unit2,
  max(CASE WHEN i = 1 THEN cod END) AS first_cod, max(CASE WHEN i = 1 THEN person_age END) AS first_age
FROM r GROUP BY case_id
""", "persons")
def agg_first_nth(t):
    people = persons(t)
    order = ["person_age", "rec_id"]
    pair = nth_by(people, "case_id", order, ["victim", "unit"], 2)
    first = first_by(people, "case_id", order, {"first_cod": "cod", "first_age": "person_age"})
    return pair.join(first, "case_id")


SQL_ROLLUP = f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY -({SQL_TYPE_RANK}), date, rec_id) AS i,
    coalesce(regexp_matches(vpursuit, 'not related'), false) AS unrelated FROM fatalities),
base AS (
  SELECT case_id AS incident_num, max(CASE WHEN i = 1 THEN date END) AS date, max(CASE WHEN i = 1 THEN incident_type END) AS incident_type,
    max(CASE WHEN i = 1 THEN policy_period END) AS policy_period, max(CASE WHEN i = 1 THEN agency END) AS agency,
    max(CASE WHEN i = 1 THEN vpursuit END) AS vpursuit, max(CASE WHEN i = 1 THEN year END) AS year,
    max(CASE WHEN i = 1 THEN agency_type END) AS agency_type, max(CASE WHEN i = 1 THEN district END) AS district,
    max(CASE WHEN i = 1 THEN url_click END) AS url_click, CAST(count(*) AS BIGINT) AS fatalities, max(unrelated) AS unrelated,
    CAST(sum(CASE WHEN coalesce(regexp_matches(victim, 'Subject'), false) THEN 1 ELSE 0 END) AS BIGINT) AS sk,
    CAST(CASE WHEN count(victim) = count(*) THEN sum(CASE WHEN victim = 'Passenger' THEN 1 ELSE 0 END) END AS BIGINT) AS pk,
    CAST(CASE WHEN count(victim) = count(*) THEN sum(CASE WHEN victim = 'Bystander' THEN 1 ELSE 0 END) END AS BIGINT) AS bk,
    CAST(CASE WHEN count(victim) = count(*) THEN sum(CASE WHEN victim = 'Officer' THEN 1 ELSE 0 END) END AS BIGINT) AS ok,
    CAST(sum(CASE WHEN coalesce(regexp_matches(injury, 'Subject'), false) THEN 1 ELSE 0 END) AS BIGINT) AS si,
    CAST(sum(CASE WHEN coalesce(regexp_matches(injury, 'Passenger'), false) THEN 1 ELSE 0 END) AS BIGINT) AS pi,
    CAST(sum(CASE WHEN coalesce(regexp_matches(injury, 'Bystander'), false) THEN 1 ELSE 0 END) AS BIGINT) AS bi,
    CAST(sum(CASE WHEN coalesce(regexp_matches(injury, 'Officer'), false) THEN 1 ELSE 0 END) AS BIGINT) AS oi
  FROM ranked GROUP BY case_id),
masked AS (SELECT * REPLACE (CASE WHEN NOT unrelated THEN sk END AS sk, CASE WHEN NOT unrelated THEN si END AS si,
    CASE WHEN NOT unrelated THEN pi END AS pi, CASE WHEN NOT unrelated THEN bi END AS bi, CASE WHEN NOT unrelated THEN oi END AS oi) FROM base),
incidents AS (SELECT incident_num, date, year, incident_type, policy_period, vpursuit, agency, agency_type, district, url_click, fatalities,
    CASE WHEN fatalities = 1 THEN 'single' ELSE 'mult' END AS inci_mapmult,
    sk AS subjects_killed, pk AS passengers_killed, bk AS bystanders_killed, ok AS officers_killed,
    si AS subjects_injured, pi AS passengers_injured, bi AS bystanders_injured, oi AS officers_injured,
    pk + bk + ok AS pbo_killed, pk + bk AS pb_killed, si + pi + bi + oi AS total_injuries, pi + bi + oi AS pbo_injured,
    pi + bi AS pb_injured, pk + bk + ok + pi + bi + oi AS pbo_total, pk + bk + pi + bi AS pb_total,
    CAST(pk + bk + ok + pi + bi + oi > 0 AS INT) AS pbo_any, CAST(pk + bk + pi + bi > 0 AS INT) AS pb_any FROM masked)
"""

FIRST_OUT = ["incident_num", "date", "year", "incident_type", "policy_period", "vpursuit", "agency",
             "agency_type", "district", "url_click"]
COUNTS_OUT = ["fatalities", "inci_mapmult", "subjects_killed", "passengers_killed", "bystanders_killed",
              "officers_killed", "subjects_injured", "passengers_injured", "bystanders_injured",
              "officers_injured", "pbo_killed", "pb_killed", "total_injuries", "pbo_injured", "pb_injured",
              "pbo_total", "pb_total", "pbo_any", "pb_any"]


def incidents(t):
    """Incident table of the test data; the layout lacks two of the report's columns."""
    people = fatalities(t).withColumns({"leg_year": F.lit(None).cast("string"), "url_info": F.col("url_click")})
    return build_incidents(people)


@query(f"WITH {SQL_ROLLUP} SELECT * FROM incidents", "fatalities")
def incident_rollup(t):
    return incidents(t).select(*FIRST_OUT, *COUNTS_OUT)


@query("""
SELECT county, CAST(min(year(date)) AS INT) AS min_yr, CAST(max(year(date)) AS INT) AS max_yr, max(age) AS max_age, avg(custkey) AS mean_cust
FROM cases GROUP BY county
""", "cases")
def agg_minmax(t):
    return cases(t).groupBy("county").agg(
        F.min(F.year("date")).alias("min_yr"), F.max(F.year("date")).alias("max_yr"),
        F.max("age").alias("max_age"), F.avg("custkey").alias("mean_cust"),
    )


@query("""
SELECT county, victim, n, CAST(sum(n) OVER (PARTITION BY county) AS BIGINT) AS total
FROM (SELECT county, victim, count(*) AS n FROM deaths GROUP BY ALL)
""", "deaths")
def window_group_total(t):
    """Total per group next to each count; the groups are aggregated before the total."""
    return tables.breakdown(deaths(t), "county", "victim", base=F.lit(1)).select(
        "county", "victim", F.col("Number").alias("n"), F.col("Total").alias("total")
    )


@query("SELECT DISTINCT agency_type, district FROM cases ORDER BY ALL", "cases")
def agg_distinct(t):
    return cases(t).select("agency_type", "district").distinct().orderBy("agency_type", "district")


@query("""
SELECT incident_type, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM fatalities GROUP BY incident_type
""", "fatalities")
def agg_share(t):
    return tables.with_share(tables.count_by(fatalities(t), "incident_type", out="n"), "n", "share")


@query(f"""
WITH n AS (SELECT incident_type, CAST(count(*) AS BIGINT) AS n FROM fatalities GROUP BY 1)
SELECT incident_type, n AS "Number", {SQL_PCT.format(x="n / (SELECT sum(n) FROM n)")} AS "Percent" FROM n
UNION ALL SELECT 'Total', CAST(sum(n) AS BIGINT), '100.0%' FROM n
""", "fatalities")
def agg_total_row(t):
    return tables.share_table(fatalities(t), "incident_type")


@query("""
SELECT *, l_orderkey || 'u' || l_linenumber || 'p' || person_no AS record_id,
  lag(l_partkey) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY person_no) AS previous_partkey FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_returnflag, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS person_no FROM lineitem)
""")
def running_number(t):
    order = ["l_returnflag", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    rows = t.lineitem.select("l_orderkey", "l_linenumber", *order)
    numbered = person_ids(rows, "l_orderkey", "l_linenumber", order)
    return with_previous(
        numbered, ["l_orderkey", "l_linenumber"], "person_no", {"previous_partkey": "l_partkey"}
    ).drop("l_returnflag", "l_quantity", "l_extendedprice")


@query(f"""
SELECT case_id, coalesce(CASE WHEN age = 9 THEN case_id % 100 END, 100 + row_number() OVER (ORDER BY -({SQL_TYPE_RANK}), date, rec_id)) AS incident_num
FROM (SELECT case_id, age, date, CAST(case_id AS VARCHAR) AS rec_id, {{type}} AS incident_type FROM cases)
""".replace("{type}", """CASE WHEN coalesce(regexp_matches(vpursuit, 'Active|Terminated'), false) THEN 'Pursuit vehicular fatality'
     WHEN suicide = 1 THEN 'After pursuit suicide' WHEN vpursuit = 'Involved pursuit' THEN 'After pursuit homicide'
     WHEN vpursuit = 'Attempted stop' THEN 'Attempted stop fatality' WHEN vpursuit = 'Vehicle accident' THEN 'Vehicle accident fatality'
     ELSE 'All other fatalities' END"""), "cases")
def global_sequence(t):
    from incidentlab.rollup import incident_type

    rows = cases(t).select(
        "case_id", "date", F.col("case_id").cast("string").alias("rec_id"),
        incident_type().alias("incident_type"),
        F.when(F.col("age") == 9, F.col("case_id") % 100).alias("incident_num"),
    )
    return number_incidents(stage(rows)).select("case_id", "incident_num")


@query("""
SELECT o_orderpriority, o_orderdate, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS position
FROM (SELECT *  REPLACE (CAST(o_orderdate AS DATE) AS o_orderdate) FROM orders)
""")
def sort_ordinal(t):
    """Position inside three very large groups, then the report's order: level descending,
    date, key."""
    levels = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    rows = t.orders.select(
        "o_orderpriority", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderkey", "o_orderstatus"
    )
    numbered = number_within(rows, ["o_orderstatus"], ["o_orderdate", "o_orderkey"], "position")
    return numbered.orderBy(
        level_rank("o_orderpriority", levels).desc(), "o_orderdate", "o_orderkey"
    ).drop("o_orderstatus")


@query(f"""
WITH {SQL_ROLLUP} SELECT incident_num,
  CASE WHEN regexp_matches(incident_type, 'fatality') AND pbo_killed >= 1 THEN 'red'
    WHEN regexp_matches(incident_type, 'fatality') AND pbo_killed = 0 THEN 'blue'
    WHEN regexp_matches(incident_type, 'homicide') THEN 'green' WHEN regexp_matches(incident_type, 'suicide') THEN 'beige' END AS inci_mapcolor,
  inci_mapmult, 'fatalities: ' || fatalities || ' <br> injuries: ' || coalesce(CAST(total_injuries AS VARCHAR), 'NA') || ' <br> by ' || agency ||
  ' <br> date:  ' || strftime(date, '%m/%d/%y') AS marker_label FROM incidents
""", "fatalities")
def map_markers(t):
    return markers(incidents(t)).select("incident_num", "inci_mapcolor", "inci_mapmult", "marker_label")


@query("""
SELECT vpursuit, CAST(count(*) FILTER (incident_type = 'After pursuit homicide') AS BIGINT) AS "After pursuit homicide",
 CAST(count(*) FILTER (incident_type = 'Pursuit vehicular fatality') AS BIGINT) AS "Pursuit vehicular fatality",
 CAST(count(*) FILTER (incident_type = 'After pursuit suicide') AS BIGINT) AS "After pursuit suicide",
 CAST(count(*) FILTER (incident_type = 'Attempted stop fatality') AS BIGINT) AS "Attempted stop fatality",
 CAST(count(*) FILTER (incident_type = 'Vehicle accident fatality') AS BIGINT) AS "Vehicle accident fatality",
 CAST(count(*) FILTER (incident_type = 'All other fatalities') AS BIGINT) AS "All other fatalities" FROM fatalities GROUP BY vpursuit
""", "fatalities")
def pivot_crosstab(t):
    return tables.crosstab(fatalities(t), "vpursuit", "incident_type", names.INCIDENT_TYPE_LEVELS)
