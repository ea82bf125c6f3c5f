"""Breakdowns, grids, periods and rates."""

from datetime import date

from pyspark.sql import functions as F

from incidentlab import names, periods, tables
from incidentlab.flows import report

from .aggregation import incidents
from .base import POLICY, SQL_AFTER, SQL_PURSUIT, SQL_VEHICULAR, cases, deaths, fatalities, query
from .cleaning import SQL_RETYPE

COUNT = "CAST(count(*) AS BIGINT)"
LONG_SQL = f"""
long AS (SELECT rec_id, date, policy_period, incident_type, victim, member AS agency, {SQL_RETYPE} AS agency_type
  FROM (SELECT *, unnest(string_split(agency, ', ')) AS member FROM fatalities WHERE {SQL_PURSUIT}))
"""


def agency_long(t):
    return report.agency_cases(fatalities(t))


def _cells(name: str, cond: str, strict: bool) -> str:
    out = []
    for p in names.PERIODS:
        here = f"policy_period = '{p}'"
        known = f" AND count(*) FILTER ({here} AND ({cond}) IS NOT NULL) = count(*) FILTER ({here})" if strict else ""
        out.append(
            f"CAST(CASE WHEN count(*) FILTER ({here}) > 0{known} THEN count(*) FILTER ({here} AND {cond}) END AS BIGINT) AS {name}_{p}"
        )
    return ", ".join(out)


MEASURES = [
    ("fatalities", "true", False),
    ("pursuit_veh_fatalities", "regexp_matches(incident_type, 'vehicular')", False),
    ("after_pursuit_homicides", "regexp_matches(incident_type, 'homicide')", False),
    ("after_pursuit_suicides", "regexp_matches(incident_type, 'suicide')", False),
    ("subjects", "victim = 'Subject'", True), ("bystanders", "victim = 'Bystander'", True),
    ("passengers", "victim = 'Passenger'", True), ("officers", "victim = 'Officer'", True),
]


@query(f"""
WITH {LONG_SQL}, wide AS (SELECT agency, min(agency_type) AS agency_type, {", ".join(_cells(*m) for m in MEASURES)} FROM long GROUP BY agency)
SELECT *, {", ".join(f"coalesce({m[0]}_pre, 0) + coalesce({m[0]}_reform, 0) + coalesce({m[0]}_rollback, 0) AS {m[0]}_tot" for m in MEASURES)} FROM wide
""", "fatalities")
def pivot_multi_totals(t):
    return report.agency_period_matrix(agency_long(t))


@query(f"""
WITH span AS (SELECT min(year) AS lo, max(year) AS hi FROM fatalities),
grid AS (SELECT y AS year, v AS victim FROM (SELECT unnest(generate_series(lo, hi)) AS y FROM span),
  (SELECT unnest(['Officer', 'Bystander', 'Passenger', 'Subject', 'Nobody']) AS v)),
n AS (SELECT year, victim, count(*) AS c FROM fatalities WHERE {SQL_VEHICULAR} GROUP BY ALL)
SELECT CAST(grid.year AS INT) AS year, grid.victim, CAST(coalesce(c, 0) AS BIGINT) AS "Number",
  CAST(sum(coalesce(c, 0)) OVER (PARTITION BY grid.year) AS BIGINT) AS "Total"
FROM grid LEFT JOIN n ON grid.year = n.year AND grid.victim = n.victim
""", "fatalities")
def grid_complete(t):
    return report.calendar_grid(
        fatalities(t), "vehicular", "victim", [*names.VICTIM_LEVELS, "Nobody"]
    )


@query(f"""
SELECT county, victim, "Number", "Total", "Total" / sum("Number") OVER () AS "Percent" FROM (
 SELECT *, CAST(sum("Number") OVER (PARTITION BY county) AS BIGINT) AS "Total" FROM (
  SELECT county, victim, {COUNT} AS "Number" FROM fatalities WHERE {SQL_VEHICULAR} GROUP BY ALL))
""", "fatalities")
def breakdown_county(t):
    """Ordered by the county's total, as the bars of the plot."""
    return report.place_breakdown(fatalities(t), "vehicular", "county", "victim").orderBy(
        "Total", "county", "victim"
    )


@query(f"""
WITH {LONG_SQL}
SELECT *, "Total" / (SELECT count(*) FROM fatalities WHERE {SQL_VEHICULAR}) AS "Percent" FROM (
 SELECT *, CAST(sum("Number") OVER (PARTITION BY agency) AS BIGINT) AS "Total" FROM (
  SELECT replace(replace(replace(agency, 'Washington', 'WA'), 'County Sheriff''s Office', 'Co SO'), 'Police Department', 'PD') AS agency,
    victim, {COUNT} AS "Number" FROM long WHERE {SQL_VEHICULAR} GROUP BY ALL))
""", "fatalities")
def breakdown_agency(t):
    people = fatalities(t)
    return report.agency_breakdown(report.agency_cases(people), people, "vehicular", "agency", "victim")


BREAKDOWN_DIMS = ["county", "city", "district", "policy_period", "year"]


@query(f"""
SELECT dimension, value, victim, "Number", "Total", "Total" / sum("Number") OVER (PARTITION BY dimension) AS "Percent" FROM (
  SELECT *, CAST(sum("Number") OVER (PARTITION BY dimension, value) AS BIGINT) AS "Total" FROM (
  {" UNION ALL ".join(f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, victim, {COUNT} AS Number FROM fatalities WHERE {SQL_PURSUIT} GROUP BY ALL"
                      for d in BREAKDOWN_DIMS)}))
""", "fatalities")
def breakdown_dimensions(t):
    """Place, period and year tables of the report from one read of the records."""
    return tables.breakdowns(report.subset(fatalities(t), "pursuit"), BREAKDOWN_DIMS, "victim")


@query(f"""
WITH {LONG_SQL}
SELECT *, "Total" / (SELECT count(*) FROM fatalities WHERE {SQL_AFTER}) AS "Percent" FROM (
 SELECT *, CAST(sum("Number") OVER (PARTITION BY agency_type) AS BIGINT) AS "Total" FROM (
  SELECT agency_type, incident_type, {COUNT} AS "Number" FROM long WHERE {SQL_AFTER} GROUP BY ALL))
""", "fatalities")
def breakdown_agency_type(t):
    people = fatalities(t)
    return report.agency_breakdown(
        report.agency_cases(people), people, "after", "agency_type", "incident_type"
    )


@query(f"""
SELECT agency, victim, "Number", "Total", "Total" / sum("Number") OVER () AS "Percent" FROM (
 SELECT *, CAST(sum("Number") OVER (PARTITION BY agency) AS BIGINT) AS "Total" FROM (
  SELECT CASE WHEN regexp_matches(agency, ',') THEN 'Multiple agencies' ELSE replace(replace(replace(agency, 'Washington', 'WA'),
    'County Sheriff''s Office', 'Co SO'), 'Police Department', 'PD') END AS agency, victim, {COUNT} AS "Number"
  FROM fatalities WHERE {SQL_VEHICULAR} GROUP BY ALL))
""", "fatalities")
def breakdown_agency_grouped(t):
    return report.grouped_agency_breakdown(fatalities(t), "vehicular", "victim")


@query(f"""
WITH b AS (SELECT *, "Total" / sum("Number") OVER () AS "Percent" FROM (
 SELECT *, CAST(sum("Number") OVER (PARTITION BY name) AS BIGINT) AS "Total" FROM (
  SELECT name, incident_type, {COUNT} AS "Number" FROM fatalities WHERE {SQL_AFTER} GROUP BY ALL)))
SELECT *, round((SELECT sum("Percent") FROM b WHERE "Total" >= 12), 9) AS shown FROM b WHERE "Total" >= 12
""", "fatalities")
def breakdown_having(t):
    kept = report.place_breakdown(fatalities(t), "after", "name", "incident_type", min_total=12)
    return kept.withColumn("shown", F.round(tables.coverage_of(kept).scalar(), 9))


@query("""
WITH r AS (SELECT * FROM fatalities WHERE vpursuit <> 'Reviewed not related'),
g AS (SELECT CAST(year AS VARCHAR) AS year, CAST(count(NULLIF(cod, 'Gunshot')) AS BIGINT) AS "FE_ID", CAST(count(victim) AS BIGINT) AS "MPV_ID",
  CAST(count(injury) AS BIGINT) AS "WaPo_ID", CAST(count(agency_type) AS BIGINT) AS "WaLocal_ID", CAST(count(*) AS BIGINT) AS "Total_Cases"
  FROM r GROUP BY year),
s AS (SELECT *, round_even(100 * "Total_Cases" / (SELECT sum("Total_Cases") FROM g), 1) AS "Percent" FROM g)
SELECT * FROM s UNION ALL SELECT 'Total', CAST(sum("FE_ID") AS BIGINT), CAST(sum("MPV_ID") AS BIGINT), CAST(sum("WaPo_ID") AS BIGINT),
  CAST(sum("WaLocal_ID") AS BIGINT), CAST(sum("Total_Cases") AS BIGINT), round_even(sum("Percent"), 1) FROM s
""", "fatalities")
def source_coverage(t):
    people = fatalities(t).withColumns({
        "fe_id": F.nullif("cod", F.lit("Gunshot")), "mpv_id": F.col("victim"),
        "wapo_id": F.col("injury"), "wa_id": F.col("agency_type"),
    })
    return report.coverage_table(people)


@query(f"""
WITH v AS (SELECT * FROM fatalities)
SELECT count(*) FILTER ({SQL_PURSUIT}) / count(*) AS pct_p, count(*) FILTER ({SQL_VEHICULAR}) / count(*) AS pct_pvf,
  count(*) FILTER ({SQL_AFTER} AND cod = 'Gunshot') / count(*) FILTER ({SQL_AFTER}) AS pct_shot_apf,
  CASE WHEN count(*) FILTER ({SQL_VEHICULAR} AND victim IS NULL) = 0
    THEN count(*) FILTER ({SQL_VEHICULAR} AND victim = 'Subject') / count(*) FILTER ({SQL_VEHICULAR}) END AS pct_subject_pvf FROM v
""", "fatalities")
def summary_ratios(t):
    return tables.summary_ratios(fatalities(t))


@query(f"""
SELECT count(DISTINCT case_id) FILTER ({SQL_PURSUIT}) / count(DISTINCT case_id) AS pct_i_p FROM fatalities
""", "fatalities")
def summary_incident_ratio(t):
    return tables.incident_ratio(incidents(t))


@query(f"""
WITH g AS (SELECT CAST(n AS VARCHAR) AS fatalities, {COUNT} AS n FROM (SELECT case_id, count(*) AS n FROM fatalities GROUP BY 1) GROUP BY 1)
SELECT fatalities, n AS "Number", format('{{:.1f}}%', round(100 * n / (SELECT sum(n) FROM g), 1)) AS "Percent" FROM g
UNION ALL SELECT 'Total', CAST(sum(n) AS BIGINT), format('{{:.1f}}%', 100.0) FROM g
""", "fatalities")
def report_deaths_per_incident(t):
    return tables.share_table(incidents(t), "fatalities")


@query("""
SELECT period, from_date, to_date, CAST(to_date - from_date AS BIGINT) AS days, round((to_date - from_date) / 365, 6) AS years,
  CAST(from_date - CAST(to_date - from_date AS INTEGER) AS DATE) AS lookback_start FROM (
  SELECT 'pre' AS period, DATE '1995-01-01' AS from_date, DATE '1998-07-01' AS to_date
  UNION ALL SELECT 'reform', DATE '1998-07-01', DATE '2000-06-01'
  UNION ALL SELECT 'rollback', DATE '2000-06-01', CAST(max(o_orderdate) AS DATE) FROM orders)
""")
def period_lengths(t):
    out = periods.period_lengths(t.orders, "o_orderdate", POLICY.start, POLICY.reform, POLICY.rollback)
    return out.withColumn("days", F.col("days").cast("long"))


@query("""
WITH m AS (SELECT date_trunc('month', o_orderdate) AS d, count(*) AS n FROM orders GROUP BY 1),
spine AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 MONTH)) AS DATE) AS index_date)
SELECT index_date, CAST(year(index_date) AS INT) AS year, strftime(index_date, '%b') AS mon, strftime(index_date, '%b.%Y') AS mon_yr, n AS num,
  CASE WHEN index_date < DATE '1998-07-01' THEN 'pre' WHEN index_date < DATE '2000-06-01' THEN 'reform' ELSE 'rollback' END AS policy_period
FROM spine LEFT JOIN m ON index_date = CAST(d AS DATE)
""")
def month_spine(t):
    return periods.monthly_counts(t.orders, "o_orderdate", POLICY)


@query(f"""
WITH m AS (SELECT date_trunc('month', date) AS d, count(*) AS n FROM fatalities WHERE {SQL_VEHICULAR} GROUP BY 1),
p AS (SELECT CASE WHEN d < DATE '1998-07-01' THEN 'pre' WHEN d < DATE '2000-06-01' THEN 'reform' ELSE 'rollback' END AS policy_period,
  CAST(sum(n) AS BIGINT) AS fatalities FROM m GROUP BY 1),
q AS (SELECT *, CASE policy_period WHEN 'pre' THEN round_even(1277 / 30, 1) WHEN 'reform' THEN round_even(701 / 30, 1)
  ELSE round_even(426 / 30, 1) END AS months FROM p),
r AS (SELECT *, round_even(fatalities / months, 2) AS monthly_rate FROM q)
SELECT *, round_even(monthly_rate * 12, 1) AS annualized_rate FROM r
""", "fatalities")
def annualized_rates(t):
    return report.annualized_rates(fatalities(t), POLICY)


def _side_sql(rows: str, lower: str, boundary: str, upper: str, sides: tuple[str, str]) -> str:
    strict = ", ".join(
        f"CAST(CASE WHEN count(victim) = count(*) THEN count(*) FILTER (victim = '{v}') END AS BIGINT) AS \"{v}\""
        for v in names.VICTIM_LEVELS
    )
    return f"""
SELECT CASE WHEN date < DATE '{boundary}' THEN '{sides[0]}' ELSE '{sides[1]}' END AS side, {strict}, CAST(count(*) AS BIGINT) AS "Total"
FROM fatalities WHERE {rows} AND date > DATE '{lower}' {upper} GROUP BY 1"""


@query(_side_sql(SQL_VEHICULAR, "1996-07-30", "1998-07-01", "AND date < DATE '2000-06-01'", ("Pre-reform", "Post-reform")), "fatalities")
def prepost_reform(t):
    return report.reform_comparison(fatalities(t), POLICY)


@query(_side_sql(SQL_AFTER, "1999-04-02", "2000-06-01", "", ("Pre-rollback", "Post-rollback")), "fatalities")
def prepost_rollback(t):
    return report.rollback_comparison(fatalities(t), POLICY, "after")


CHANGE_SQL = """
SELECT 'reform' AS boundary, n_before, n_after, n_after / n_before - 1 AS pct_change FROM (
  SELECT count(*) FILTER (date < DATE '1998-07-01') AS n_before, count(*) FILTER (date >= DATE '1998-07-01') AS n_after FROM src
  WHERE date > DATE '1996-07-30' AND date < DATE '2000-06-01')
UNION ALL SELECT 'rollback', n_before, n_after, n_after / n_before - 1 FROM (
  SELECT count(*) FILTER (date < DATE '2000-06-01') AS n_before, count(*) FILTER (date >= DATE '2000-06-01') AS n_after FROM src
  WHERE date > DATE '1999-04-02')
"""


def _changes(df):
    return periods.pct_changes(df, "date", {
        "reform": (POLICY.reform, POLICY.days["reform"], POLICY.rollback),
        "rollback": (POLICY.rollback, POLICY.days["rollback"], None),
    })


@query("WITH src AS (SELECT CAST(o_orderdate AS DATE) AS date FROM orders)" + CHANGE_SQL)
def prepost_pct_change(t):
    return _changes(t.orders.select(F.col("o_orderdate").cast("date").alias("date")))


@query(f"""
WITH src AS (SELECT date FROM (SELECT date, CASE WHEN age = 1 AND order_status = 'F' THEN 'Attempted stop' ELSE vpursuit END AS vpursuit FROM cases)
  WHERE regexp_matches(vpursuit, 'Active|Terminated'))""" + CHANGE_SQL, "cases")
def prepost_sensitivity(t):
    """The change once ambiguous cases are recoded as attempted stops."""
    from incidentlab.clean import apply_fixes

    base = cases(t)
    doubtful = base.where((F.col("age") == 1) & (F.col("order_status") == "F")).select(
        "case_id", F.lit("vpursuit").alias("column_name"), F.lit("Attempted stop").alias("new_value")
    )
    recoded = apply_fixes(
        base.select("case_id", "date", "vpursuit"), doubtful, "case_id", ["vpursuit"])
    return _changes(recoded.where(F.col("vpursuit").rlike("Active|Terminated")))


@query(f"""
WITH f AS (SELECT *, CASE WHEN month(date) >= 8 THEN year(date) ELSE year(date) - 1 END AS y FROM fatalities WHERE {SQL_VEHICULAR} AND date > DATE '1995-07-31'),
grid AS (SELECT DISTINCT y, v FROM f, (SELECT unnest(['Officer', 'Bystander', 'Passenger', 'Subject']) AS v)),
n AS (SELECT y, victim, count(*) AS c FROM f GROUP BY ALL)
SELECT grid.y || '-' || (grid.y + 1) AS leg_year, v AS victim, CAST(coalesce(c, 0) AS BIGINT) AS "Number",
  CAST(sum(coalesce(c, 0)) OVER (PARTITION BY grid.y) AS BIGINT) AS "Total" FROM grid LEFT JOIN n ON n.y = grid.y AND n.victim = v
""", "fatalities")
def fiscal_year_counts(t):
    return report.legislative_grid(
        fatalities(t), "vehicular", "victim", names.VICTIM_LEVELS, F.lit(date(1995, 7, 31))
    )


@query(f"""
SELECT policy_period, victim, "Number", "Total", "Total" / sum("Number") OVER () AS "Percent" FROM (
 SELECT *, CAST(sum("Number") OVER (PARTITION BY policy_period) AS BIGINT) AS "Total" FROM (
  SELECT policy_period, victim, {COUNT} AS "Number" FROM fatalities WHERE {SQL_VEHICULAR} GROUP BY ALL))
""", "fatalities")
def breakdown_period(t):
    return report.period_breakdown(fatalities(t), "vehicular", "victim")
