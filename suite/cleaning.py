"""Classification, recoding, corrections and strings."""

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlab import clean, corrections, names, periods
from incidentlab.flows.report import cause_group
from incidentlab.io import stage
from incidentlab.multivalue import (
    abbreviate, collapse_multiple, explode_members, narrow_members, retype_members, widen_members,
)
from incidentlab.rsem import first_match, if_else_na, level_rank, paste

from .base import POLICY, SQL_INCIDENT_TYPE, SQL_PERIOD, cases, deaths, fatalities, query


@query("""
SELECT rec_id, incident_type,
  CASE WHEN incident_type = 'Pursuit vehicular fatality' THEN 'Pursuit vehicular fatality'
    WHEN cod = 'Gunshot' THEN 'Gunshot' WHEN cod = 'Taser' THEN 'Taser'
    WHEN coalesce(regexp_matches(cod, 'Asphyx'), false) THEN 'Asphyxiated/Restrained' ELSE 'All other causes' END AS cod_cat,
  CASE WHEN cod IN ('Vehicle', 'Gunshot') THEN cod ELSE 'Other' END AS cod3,
  CASE WHEN person_age IS NULL THEN NULL WHEN person_age = 4 THEN make_date(year, month(date), day) END AS death_date
FROM fatalities
""", "fatalities")
def classify_case(t):
    df = clean.classify(fatalities(t), "cod_cat", [(F.lit(True), cause_group())])
    died = F.make_date("year", F.month("date"), "day")
    return df.select(
        "rec_id", "incident_type", "cod_cat", "cod3",
        if_else_na(F.col("person_age") == 4, died, F.lit(None).cast("date")).alias("death_date"),
    )


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CAST(NULLIF(l_linenumber, 7) = 3 OR NULLIF(CAST(l_quantity AS INT) % 5, 0) = 3 OR CAST(round(l_tax * 100) AS INT) = 3 AS INT) AS code_flag,
  CAST(coalesce(l_shipmode_text LIKE '%AF%', false) OR coalesce(other_text LIKE '%AF%', false) AS INT) AS text_flag
FROM (SELECT *, NULLIF(l_returnflag || l_linestatus, 'NO') AS l_shipmode_text,
  CASE WHEN l_linenumber > 5 THEN l_returnflag || 'F' END AS other_text FROM lineitem)
""")
def any_code_flag(t):
    df = t.lineitem.withColumns({
        "c1": F.nullif("l_linenumber", F.lit(7)),
        "c2": F.nullif(F.col("l_quantity").cast("int") % 5, F.lit(0)),
        "c3": F.round(F.col("l_tax") * 100).cast("int"),
        "t1": F.nullif(F.concat("l_returnflag", "l_linestatus"), F.lit("NO")),
        "t2": F.when(F.col("l_linenumber") > 5, F.concat("l_returnflag", F.lit("F"))),
    })
    return df.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        clean.any_code(["c1", "c2", "c3"], 3).alias("code_flag"),
        clean.any_match(["t1", "t2"], "AF").alias("text_flag"),
    )


@query("""
SELECT doc_id,
  CASE WHEN regexp_matches(lower(text), 'email|phone|password') THEN 1
    WHEN regexp_matches(lower(text), 'vehicle|car|crash|speed|chase|pursuit|flee|fled') THEN 2
    WHEN lang = 'fr' THEN 3 END AS tag,
  CASE WHEN regexp_matches(text, 'the') THEN 'yes' ELSE 'no' END AS has_the
FROM documents
""")
def text_keyword_tag(t):
    df = t.documents.withColumn("lang_fr", F.col("lang") == "fr")
    df = clean.tag_text(
        df, "text", [("email|phone|password", 1), (names.VEHICLE_WORDS, 2)], "word_tag",
        ignore_case=True,
    )
    df = clean.tag_text(df, "text", [("the", "yes")], "has_the", default="no")
    tag = F.coalesce("word_tag", F.when(F.col("lang_fr"), 3))
    return df.select("doc_id", tag.alias("tag"), "has_the")


@query("""
SELECT c_custkey, coalesce(s.label, 'unlisted') AS nation_label,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Building' WHEN 'MACHINERY' THEN 'Machines' ELSE c_mktsegment END AS segment,
  coalesce(s.label, CAST(c_nationkey AS VARCHAR)) AS label_or_code
FROM customer LEFT JOIN (SELECT n_nationkey, n_name AS label FROM nation WHERE n_regionkey <> 2) s ON c_nationkey = n_nationkey
""")
def lookup_recode(t):
    codes = t.nation.where(F.col("n_regionkey") != 2)
    df = clean.recode(t.customer, "c_nationkey", codes, "n_nationkey", "n_name", "label")
    df = clean.recode(
        df, "c_nationkey", codes, "n_nationkey", "n_name", "label_or_code", keep_unmatched=True
    )
    return df.select(
        "c_custkey", F.coalesce("label", F.lit("unlisted")).alias("nation_label"),
        clean.recode_values(
            "c_mktsegment", {"BUILDING": "Building", "MACHINERY": "Machines"}
        ).alias("segment"),
        "label_or_code",
    )


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, coalesce(NULLIF(l_linenumber, 2), 0) AS cf1,
  coalesce(NULLIF(CAST(l_quantity AS INT) % 4, 3), 0) AS cf2 FROM lineitem
""")
def fill_nulls(t):
    df = t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", F.nullif("l_linenumber", F.lit(2)).alias("cf1"),
        F.nullif(F.col("l_quantity").cast("int") % 4, F.lit(3)).alias("cf2"),
    )
    return clean.fill_zero(df, ["cf1", "cf2"])


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN '9-FIXED' ELSE o_orderpriority END AS o_orderpriority,
  CASE WHEN o_totalprice < 5000 THEN -1 ELSE o_custkey END AS o_custkey FROM orders
""")
def apply_corrections(t):
    base = t.orders.select("o_orderkey", "o_orderpriority", "o_custkey", "o_totalprice")
    high = base.where(F.col("o_totalprice") > 400000).select(
        "o_orderkey", F.lit("o_orderpriority").alias("column_name"), F.lit("9-FIXED").alias("new_value")
    )
    low = base.where(F.col("o_totalprice") < 5000).select(
        "o_orderkey", F.lit("o_custkey").alias("column_name"), F.lit("-1").alias("new_value")
    )
    return clean.apply_fixes(base.drop("o_totalprice"), high.unionByName(low), "o_orderkey")


@query("""
SELECT k AS l_orderkey, unit, l_partkey, l_suppkey,
  CASE WHEN k % 20 = 0 AND unit = 4 THEN NULL ELSE
    CASE WHEN k % 8 = 0 AND unit IN (1, 2) THEN 7 ELSE qty + CASE WHEN k % 4 = 0 THEN 3 ELSE 0 END END
    + CASE WHEN k % 8 = 0 AND flag = 'R' THEN 1 ELSE 0 END + CASE WHEN k % 20 = 0 THEN 2 ELSE 0 END END AS qty,
  CASE WHEN k % 10 = 0 AND unit = 3 THEN 'X' WHEN k % 5 = 0 AND unit IN (2, 3) THEN NULL ELSE flag END AS flag
FROM (SELECT l_orderkey AS k, l_linenumber AS unit, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS qty, l_returnflag AS flag FROM lineitem)
""")
def corrections_in_order(t):
    """Rules by case, by unit or list of units and by flag: added, set and made missing, in order."""
    rows = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("unit"), "l_partkey", "l_suppkey",
                             F.col("l_quantity").cast("long").alias("qty"), F.col("l_returnflag").alias("flag"))
    cases_ = t.orders.select(F.col("o_orderkey").alias("l_orderkey"))

    def rule(number, every, column, op, value=None, unit=(), flag=None):
        units = F.array(*map(F.lit, unit)).cast("array<int>") if unit else F.lit(None).cast("array<int>")
        return cases_.where(F.col("l_orderkey") % every == 0).select(
            "l_orderkey", F.lit(number).alias("rule"), F.lit(column).alias("column_name"), F.lit(op).alias("op"),
            F.lit(value).cast("string").alias("value"), units.alias("unit"), F.lit(flag).cast("string").alias("flag"))

    rules = stage(reduce(DataFrame.unionByName, [
        rule(1, 4, "qty", "add", 3), rule(2, 8, "qty", "set", 7, unit=(1, 2)), rule(3, 8, "qty", "add", 1, flag="R"),
        rule(4, 5, "flag", "missing", unit=(2, 3)), rule(5, 10, "flag", "set", "X", unit=(3,)),
        rule(6, 20, "qty", "missing", unit=(4,)), rule(7, 20, "qty", "add", 2),
    ]))
    return corrections.correct(rows, rules, "l_orderkey", ["qty", "flag"], conditions=["unit", "flag"])


# A period of two days from every other day on that some case has, so that there are gaps.
SQL_PERIOD_TABLE = """
periods AS (SELECT DISTINCT strftime(date, 'from %Y-%m-%d') AS period, date AS from_date, date + {days} AS to_date FROM cases
  WHERE (date - DATE '1900-01-01') % {every} = 0)
"""


def period_table_of(t, every, days):
    first = cases(t).where(F.datediff("date", F.lit(date(1900, 1, 1))) % every == 0)
    return stage(first.select(F.concat(F.lit("from "), F.date_format("date", "yyyy-MM-dd")).alias("period"),
                              F.col("date").alias("from_date"), F.date_add("date", days).alias("to_date")).distinct())


@query("WITH " + SQL_PERIOD_TABLE.strip().format(every=3, days=2) + """
SELECT case_id, date, period FROM cases LEFT JOIN periods ON date >= from_date AND date < to_date
""", "cases")
def period_from_table(t):
    """Days labelled by a table of periods with gaps between them."""
    return periods.label_from_table(cases(t).select("case_id", "date"), "date", period_table_of(t, 3, 2))


@query("WITH " + SQL_PERIOD_TABLE.strip().format(every=1, days=40) + """
SELECT rec_id, date, (SELECT max_by(period, from_date) FROM periods p WHERE p.from_date <= d.date AND d.date < p.to_date) AS period
FROM deaths d
""", "deaths")
def period_overlaps(t):
    """Periods of forty days that begin on every day: the latest one that has begun counts."""
    return periods.label_from_table(
        deaths(t).select("rec_id", "date"), "date", period_table_of(t, 1, 40), overlap="later")


@query("""
SELECT o_orderkey, o_custkey FROM orders
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)
""")
def apply_exclusions(t):
    bad = t.customer.where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("o_custkey"))
    return clean.exclude(t.orders.select("o_orderkey", "o_custkey"), bad)


@query("""
SELECT d.doc_id, coalesce(CASE quality WHEN 1 THEN 'Good text' WHEN 0 THEN NULL END, 'draft ' || lang) AS coding,
  coalesce(CAST(NULLIF(toxic, 0) AS VARCHAR), source) AS note
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def coding_overlay(t):
    draft = t.documents.select(
        "doc_id", F.concat(F.lit("draft "), "lang").alias("coding"), F.col("source").alias("note")
    )
    final = t.labels.select(
        "doc_id", F.when(F.col("quality") == 1, "Good text").alias("coding_final"),
        F.nullif("toxic", F.lit(0)).cast("string").alias("note_final"),
    )
    return clean.overlay(draft, final, "doc_id", {"coding": "coding_final", "note": "note_final"})


@query(f"""
SELECT case_id, {SQL_PERIOD} AS policy_period,
  CAST(date >= DATE '1998-07-01' AND date < DATE '2000-06-01' AS INT) AS reform_period,
  CAST(date >= DATE '2000-06-01' AS INT) AS rollback_period FROM cases
""", "cases")
def period_label(t):
    return clean.label_period(
        cases(t).select("case_id", "date"), "date", POLICY.bounds, dummies=["reform", "rollback"]
    ).drop("date")


@query("""
SELECT case_id, agency1, agency2, agency3, agency4, agency5, agency6 FROM (
  SELECT case_id, string_split(agency, ', ') AS p FROM cases) s,
  LATERAL (SELECT coalesce(p[1], '') AS agency1, coalesce(p[2], '') AS agency2, coalesce(p[3], '') AS agency3,
    coalesce(p[4], '') AS agency4, coalesce(p[5], '') AS agency5, coalesce(p[6], '') AS agency6) x
""", "cases")
def multivalue_wide(t):
    return widen_members(cases(t).select("case_id", "agency"), n=6).drop("agency")


@query("""
SELECT case_id, CAST(seq AS INT) AS seq, p[seq] AS agency, 'agency' || seq AS column_name FROM (
  SELECT case_id, string_split(agency, ', ') AS p, unnest(generate_series(1, len(string_split(agency, ', ')))) AS seq FROM cases)
""", "cases")
def multivalue_explode(t):
    """Exploded directly, and through the wide form: both carry the same members."""
    df = cases(t).select("case_id", "agency")
    direct = explode_members(df)
    wide = widen_members(df).drop("agency")
    long = narrow_members(wide, ["case_id"], [c for c in wide.columns if c != "case_id"])
    long = long.withColumnsRenamed({"seq": "column_name", "agency": "__agency"}).withColumn(
        "seq", F.substring("column_name", 7, 1).cast("int")
    )
    return direct.join(long, ["case_id", "seq"], "left").where(
        F.col("agency") == F.col("__agency")
    ).drop("__agency")


@query("""
SELECT case_id, CAST(2 * len(string_split(agency, ', ')) AS BIGINT) AS n_wide, CAST(2 * len(string_split(agency, ', ')) AS BIGINT) AS n_long FROM cases
""", "cases")
def multivalue_long_lists(t):
    """Lists of up to twelve members: the wide and the exploded form hold the same number."""
    df = cases(t).select("case_id", F.concat_ws(", ", "agency", "agency").alias("agency"))
    wide = widen_members(df).drop("agency")
    cells = [c for c in wide.columns if c != "case_id"]
    narrow = narrow_members(wide, ["case_id"], cells).groupBy("case_id").agg(F.count(F.lit(1)).alias("n_wide"))
    long = explode_members(df).groupBy("case_id").agg(F.count(F.lit(1)).alias("n_long"))
    return narrow.join(long, "case_id")


SQL_RETYPE = """
CASE WHEN coalesce(regexp_matches(agency_type, 'Multiple'), false) THEN
  CASE WHEN regexp_matches(member, 'Police') THEN 'Local PD' WHEN regexp_matches(member, 'Tribal') THEN 'Tribal PD'
    WHEN regexp_matches(member, 'Sherif') THEN 'County SO' WHEN regexp_matches(member, 'County') THEN 'Other County'
    WHEN regexp_matches(member, 'Correc') THEN 'Corrections' WHEN regexp_matches(member, 'Patrol') THEN 'WSP'
    WHEN regexp_matches(member, 'Fed|US') THEN 'Federal' ELSE 'Other' END
  ELSE agency_type END
"""


@query(f"""
SELECT case_id, member AS agency, {SQL_RETYPE} AS agency_type
FROM (SELECT case_id, agency_type, unnest(string_split(agency, ', ')) AS member FROM cases)
""", "cases")
def multivalue_retype(t):
    df = explode_members(cases(t).select("case_id", "agency", "agency_type"), position=None)
    return retype_members(df).select("case_id", "agency", "agency_type")


@query("""
SELECT case_id, short, CASE WHEN regexp_matches(short, ',') THEN 'Multiple agencies' ELSE short END AS label,
  replace(replace(replace(agency, 'Washington', 'WA'), 'County Sheriff''s Office', 'Co SO'), 'Police Department', 'PD') AS plot_name
FROM (SELECT *, replace(replace(replace(replace(agency, 'Washington State Patrol', 'WSP'), 'Washington', 'WA'),
  'County Sheriff''s Office', 'Co SO'), 'Police Department', 'PD') AS short FROM cases)
""", "cases")
def string_abbrev(t):
    df = cases(t).withColumn("short", abbreviate("agency"))
    return df.select(
        "case_id", "short", collapse_multiple("short").alias("label"),
        abbreviate("agency", names.AGENCY_ABBREVIATIONS_PLOT).alias("plot_name"),
    )


@query("""
SELECT p_partkey, concat_ws(' ', upper(substr(w[1], 1, 1)) || lower(substr(w[1], 2)), upper(substr(w[2], 1, 1)) || lower(substr(w[2], 2))) AS title,
  'part ' || coalesce(CAST(NULLIF(p_size, 10) AS VARCHAR), 'NA') || '/' || p_brand AS label,
  coalesce(NULLIF(p_size, 10), 999) || 'p' AS guarded
FROM (SELECT *, string_split(p_name, ' ') AS w FROM part)
""")
def string_misc(t):
    size = F.nullif("p_size", F.lit(10))
    return t.part.select(
        "p_partkey", F.initcap("p_name").alias("title"),
        paste(F.lit("part "), size, F.lit("/"), "p_brand").alias("label"),
        F.concat(F.coalesce(size, F.lit(999)).cast("string"), F.lit("p")).alias("guarded"),
    )


@query(f"""
SELECT case_id, date, year(date) AS year, month(date) AS month_no, strftime(date, '%b') AS mon,
  month(date) AS mon_from_name, day(date) AS day, strftime(date, '%m/%d/%y') AS shown FROM cases
""", "cases")
def date_parts(t):
    df = cases(t).select("case_id", "date").withColumn("mon", F.date_format("date", "MMM"))
    return df.select(
        "case_id", F.to_date(F.make_date(F.year("date"), F.month("date"), F.dayofmonth("date"))).alias("date"),
        F.year("date").alias("year"), F.month("date").alias("month_no"), "mon",
        level_rank("mon", names.MONTH_ABBREVIATIONS).alias("mon_from_name"),
        F.dayofmonth("date").alias("day"), F.date_format("date", "MM/dd/yy").alias("shown"),
    )
