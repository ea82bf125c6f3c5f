"""Joins and record linkage."""

from pyspark.sql import functions as F

from incidentlab import link
from incidentlab.io import stage
from incidentlab.rollup import attach_group, propagate
from incidentlab.rsem import natural_join

from .base import LINK_KEYS, cases, deaths, query, source_a, source_b, source_c

SAME = "a.date = b.date AND a.district = b.district AND a.age IS NOT DISTINCT FROM b.age"

# Records of one key are paired in the order of their ids; every record occurs once.
LINKED_SQL = f"""
WITH na AS (SELECT *, row_number() OVER (PARTITION BY date, district, age ORDER BY a_id) AS nth FROM sa),
nb AS (SELECT *, row_number() OVER (PARTITION BY date, district, age ORDER BY b_id) AS nth FROM sb),
linked AS (
  SELECT coalesce(a.date, b.date) AS date, coalesce(a.district, b.district) AS district, coalesce(a.age, b.age) AS age,
    a_id, b_id, a.county_code AS county_code_a, b.county_code AS county_code_b, a.city AS city_a, b.city AS city_b,
    a.persons AS persons_a, b.persons AS persons_b, a.tag AS tag_a, b.tag AS tag_b
  FROM na a FULL JOIN nb b ON {SAME} AND a.nth = b.nth)
"""


def linked(t):
    return link.link_full(stage(source_a(t)), stage(source_b(t)), LINK_KEYS, "a_id", "b_id").withColumnsRenamed(
        {"a_id_a": "a_id", "b_id_b": "b_id"}
    )


@query("""
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, o_orderstatus, p.n, s.first_ship
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
LEFT JOIN (SELECT l_orderkey AS k1, l_suppkey AS k2, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL) p
  ON k1 = l_orderkey AND k2 = l_suppkey
LEFT JOIN (SELECT l_orderkey AS k3, l_suppkey AS k4, l_linenumber AS k5, CAST(min(l_shipdate) AS DATE) AS first_ship FROM lineitem
  WHERE l_linestatus = 'F' GROUP BY ALL) s ON k3 = l_orderkey AND k4 = l_suppkey AND k5 = l_linenumber
""")
def join_left_multi(t):
    """Left equi-joins on one, two and three keys."""
    person = t.lineitem.select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey")
    crash = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    unit = t.lineitem.where(F.col("l_returnflag") == "A").groupBy("l_orderkey", "l_suppkey").agg(
        F.count(F.lit(1)).alias("n")
    )
    own = t.lineitem.where(F.col("l_linestatus") == "F").groupBy(
        "l_orderkey", "l_suppkey", "l_linenumber"
    ).agg(F.min("l_shipdate").cast("date").alias("first_ship"))
    return (
        person.join(crash, "l_orderkey", "left")
        .join(unit, ["l_orderkey", "l_suppkey"], "left")
        .join(own, ["l_orderkey", "l_suppkey", "l_linenumber"], "left")
    )


@query("""
SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey <> 3
""")
def join_lookup(t):
    """Code tables are small here; Spark's size threshold decides on the broadcast."""
    places = t.nation.withColumnRenamed("n_nationkey", "s_nationkey")
    regions = t.region.where(F.col("r_regionkey") != 3).withColumnRenamed("r_regionkey", "n_regionkey")
    return (
        t.supplier.join(places, "s_nationkey", "left").join(regions, "n_regionkey", "left")
        .select("s_suppkey", "n_name", "r_name")
    )


@query("""
SELECT l_orderkey AS orderkey, l_linenumber, l_partkey, l_suppkey, NULLIF(l_returnflag, 'A') AS flag, n
FROM lineitem LEFT JOIN (SELECT o_orderkey, NULLIF(f, 'A') AS f2, o_custkey AS n FROM orders, (VALUES ('A'), ('N')) v(f)) o
ON l_orderkey = o_orderkey AND NULLIF(l_returnflag, 'A') IS NOT DISTINCT FROM f2
""")
def join_natural(t):
    left = t.lineitem.select(
        F.col("l_orderkey").alias("orderkey"), "l_linenumber", "l_partkey", "l_suppkey",
        F.nullif("l_returnflag", F.lit("A")).alias("flag"),
    )
    right = t.orders.select(
        F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("n"),
        F.explode(F.array(F.lit(None).cast("string"), F.lit("N"))).alias("flag"),
    )
    return natural_join(left, right, expect=["orderkey", "flag"])


@query("""
SELECT coalesce(c.county, s.n_name) AS county, coalesce(c.year, s.year) AS year, c.cases, s.lines, CASE WHEN s.lines IS NULL THEN 0 ELSE 1 END AS shipped
FROM (SELECT county, year(date) AS year, count(*) AS cases FROM cases GROUP BY ALL) c
FULL JOIN (SELECT n_name, year(l_shipdate) AS year, count(*) AS lines FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL) s ON c.county = s.n_name AND c.year = s.year
""", "cases")
def join_full_presence(t):
    left = cases(t).groupBy(
        "county", F.year("date").alias("year")
    ).agg(F.count(F.lit(1)).alias("cases"))
    by_supplier = t.lineitem.groupBy("l_suppkey", F.year("l_shipdate").alias("ship_year")).agg(
        F.count(F.lit(1)).alias("n")
    )
    right = (
        by_supplier.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name", "ship_year").agg(F.sum("n").alias("lines"))
    )
    return link.join_presence(left, right, {"county": "n_name", "year": "ship_year"}, "shipped")


@query("""
SELECT case_id, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = case_id AND l_linenumber = 1) THEN 1 END AS in_first,
  CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = case_id AND l_returnflag = 'R') THEN 1 END AS in_returned
FROM cases WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = case_id AND l_linenumber = 7)
""", "cases")
def join_anti(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("case_id"), "l_linenumber", "l_returnflag")
    ids = link.unmatched(
        cases(t).select("case_id"), lines.where(F.col("l_linenumber") == 7), ["case_id"]
    )
    return link.membership(ids, "case_id", {
        "in_first": lines.where(F.col("l_linenumber") == 1),
        "in_returned": lines.where(F.col("l_returnflag") == "R"),
    })


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) OVER (PARTITION BY l_orderkey) AS records,
  CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS BIGINT) AS persons,
  max(l_linenumber) OVER (PARTITION BY l_orderkey) AS last_line FROM lineitem
""")
def group_attach(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return attach_group(rows, "l_orderkey", {
        "records": F.count(F.lit(1)), "persons": F.count_if(F.col("l_returnflag") == "A"),
        "last_line": F.max("l_linenumber"),
    }).drop("l_returnflag")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  (SELECT min(f.l_linenumber) FROM lineitem f WHERE f.l_orderkey = l.l_orderkey AND f.l_quantity > 45) AS flagged_unit,
  (SELECT count(DISTINCT f.l_linenumber) FROM lineitem f WHERE f.l_orderkey = l.l_orderkey AND f.l_quantity > 45) AS flagged_units,
  CASE WHEN EXISTS (SELECT 1 FROM lineitem f WHERE f.l_orderkey = l.l_orderkey AND f.l_linenumber = l.l_linenumber AND f.l_quantity > 45)
    THEN 1 ELSE 0 END AS in_flagged_unit FROM lineitem l
""")
def flag_propagate(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return propagate(rows, "l_orderkey", F.col("l_quantity") > 45, "l_linenumber").drop("l_quantity")


@query(LINKED_SQL + "SELECT * FROM linked", "sa sb")
def link_full_outer(t):
    return linked(t)


@query(LINKED_SQL + """
, coded AS (SELECT a_id, b_id, CASE WHEN a_id IS NULL THEN 0 WHEN tag_a = 1 THEN 2 ELSE 1 END AS status_a,
    CASE WHEN b_id IS NULL THEN 0 WHEN tag_b = 1 THEN 2 ELSE 1 END AS status_b,
    CASE WHEN age IS NULL THEN 0 ELSE 2 END AS status_fe FROM linked)
SELECT *, CASE WHEN status_fe = 2 AND status_a < 2 AND status_b < 2 THEN 'FE-only'
  WHEN status_fe = 0 AND (status_a = 2 OR status_b = 2) THEN 'W-only'
  WHEN status_fe = 2 AND (status_a = 2 OR status_b = 2) THEN 'FE+W' ELSE 'Other' END AS tag_status FROM coded
""", "sa sb")
def link_status(t):
    df = linked(t)
    df = df.withColumns({
        "tagged_a": F.when(F.col("tag_a") == 1, F.col("a_id")),
        "tagged_b": F.when(F.col("tag_b") == 1, F.col("b_id")),
    })
    df = link.status(df, {"found_a": ("a_id", 1), "found_b": ("b_id", 1),
                          "tag2_a": ("tagged_a", 2), "tag2_b": ("tagged_b", 2)})
    df = df.select(
        "a_id", "b_id", F.greatest("found_a", "tag2_a").alias("status_a"),
        F.greatest("found_b", "tag2_b").alias("status_b"),
        F.when(F.col("age").isNull(), 0).otherwise(2).alias("status_fe"),
    )
    return df.withColumn("tag_status", link.tag_status("status_fe", "status_a", "status_b"))


def _tier_sql(name, left, pool, pool_id, keys):
    """One tier: both sides numbered inside the key, paired by key and number."""
    by = ", ".join(keys)
    on = " AND ".join(f"c.{k} IS NOT DISTINCT FROM p.{k}" for k in keys)
    return f"""{name} AS (
  SELECT c.c_id, p.{pool_id} AS match_id, p.county_code, p.persons
  FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY c_id) AS nth FROM {left}) c
  JOIN (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {pool_id}) AS nth FROM {pool}) p ON {on} AND c.nth = p.nth)"""


@query(f"""
WITH {_tier_sql("t1", "sc", "(SELECT * FROM sa WHERE tag = 1)", "a_id", ["date", "county_code", "age", "city"])},
r1 AS (SELECT * FROM sc WHERE c_id NOT IN (SELECT c_id FROM t1)),
{_tier_sql("t2", "r1", "(SELECT * FROM sa WHERE tag = 0)", "a_id", LINK_KEYS)},
r2 AS (SELECT * FROM r1 WHERE c_id NOT IN (SELECT c_id FROM t2)),
{_tier_sql("t3", "r2", "(SELECT * FROM sb WHERE tag = 0)", "b_id", LINK_KEYS)},
r3 AS (SELECT * FROM r2 WHERE c_id NOT IN (SELECT c_id FROM t3))
SELECT c_id, 'both' AS tier, CAST(match_id AS VARCHAR) AS match_id, county_code, persons FROM t1
UNION ALL SELECT c_id, 'untagged a', CAST(match_id AS VARCHAR), county_code, persons FROM t2
UNION ALL SELECT c_id, 'untagged b', CAST(match_id AS VARCHAR), county_code, persons FROM t3
UNION ALL SELECT c_id, 'crowd only', NULL, NULL, NULL FROM r3
""", "sa sb sc")
def link_cascade(t):
    crowd = stage(source_c(t).select(
        "c_id", "date", "district", "age", "city", F.col("county_code").alias("place")))
    a = stage(source_a(t)).withColumn("place", F.col("county_code"))
    b = stage(source_b(t))
    return link.cascade(crowd, [
        ("both", a.where(F.col("tag") == 1), "a_id", ["date", "place", "age", "city"]),
        ("untagged a", a.where(F.col("tag") == 0), "a_id", LINK_KEYS),
        ("untagged b", b.where(F.col("tag") == 0), "b_id", LINK_KEYS),
    ], carry=["county_code", "persons"], rest="crowd only", left_id="c_id").select(
        "c_id", "tier", "match_id", "county_code", "persons"
    )


@query(LINKED_SQL + """
SELECT a_id, b_id, coalesce(county_code_a, county_code_b) AS county_code, coalesce(city_a, city_b) AS city,
  CASE WHEN persons_a IS NULL THEN persons_b WHEN persons_b IS NULL THEN persons_a
    WHEN persons_b > persons_a THEN persons_b ELSE persons_a END AS persons FROM linked
""", "sa sb")
def survivorship(t):
    return link.survive(
        linked(t),
        {"county_code": ["county_code_a", "county_code_b"], "city": ["city_a", "city_b"]},
        {"persons": ["persons_a", "persons_b"]},
    ).select("a_id", "b_id", "county_code", "city", "persons")


@query(LINKED_SQL + """
SELECT a_id, 'city' AS column_name, city_a AS value_a, city_b AS value_b FROM linked WHERE a_id IS NOT NULL AND city_a <> city_b
UNION ALL SELECT a_id, 'persons', CAST(persons_a AS VARCHAR), CAST(persons_b AS VARCHAR) FROM linked WHERE a_id IS NOT NULL AND persons_a <> persons_b
UNION ALL SELECT a_id, 'tag', CAST(tag_a AS VARCHAR), CAST(tag_b AS VARCHAR) FROM linked WHERE a_id IS NOT NULL AND tag_a <> tag_b
""", "sa sb")
def link_discrepancies(t):
    paired = linked(t).where(F.col("a_id").isNotNull())
    return link.discrepancies(
        paired, "a_id", {c: (f"{c}_a", f"{c}_b") for c in ("city", "persons", "tag")}
    )


@query(LINKED_SQL + "SELECT tag_a, tag_b, count(*) AS n FROM linked GROUP BY ALL", "sa sb")
def link_crosstab(t):
    return link.quality_crosstab(linked(t), "tag_a", "tag_b")


@query("""
WITH m AS (SELECT case_id, min(rec_id) AS lead FROM deaths WHERE vpursuit = 'Active pursuit' AND victim = 'Officer' GROUP BY case_id),
pa AS (SELECT rec_id, case_id, person_age AS age, victim,
    row_number() OVER (PARTITION BY case_id, person_age, victim ORDER BY rec_id) AS nth FROM deaths WHERE cod IS NOT NULL AND case_id IN (SELECT case_id FROM m)),
pb AS (SELECT 'b' || rec_id AS rec_id, case_id, person_age AS age, victim,
    row_number() OVER (PARTITION BY case_id, person_age, victim ORDER BY rec_id) AS nth FROM deaths WHERE unit > 2 AND case_id IN (SELECT case_id FROM m)),
x AS (SELECT coalesce(pa.case_id, pb.case_id) AS case_id, pa.rec_id AS rec_a, pb.rec_id AS rec_b FROM pa FULL JOIN pb
  ON pa.case_id = pb.case_id AND pa.age IS NOT DISTINCT FROM pb.age AND pa.victim IS NOT DISTINCT FROM pb.victim AND pa.nth = pb.nth)
SELECT case_id, rec_a, rec_b, CASE WHEN rec_a IS NULL THEN 0 ELSE 1 END AS status_a,
  CASE WHEN rec_b IS NULL THEN 0 ELSE 1 END AS status_b, lead FROM x JOIN m USING (case_id)
""", "deaths")
def link_expand_members(t):
    people = stage(deaths(t).select("rec_id", "case_id", "unit", "victim", "cod", "person_age", "vpursuit"))
    matched = people.where(
        (F.col("vpursuit") == "Active pursuit") & (F.col("victim") == "Officer")
    ).groupBy("case_id").agg(F.min("rec_id").alias("lead"))
    member = ["rec_id", "case_id", F.col("person_age").alias("age"), "victim"]
    pool_a = people.where(F.col("cod").isNotNull()).select(*member)
    pool_b = people.where(F.col("unit") > 2).select(*member).withColumn(
        "rec_id", F.concat(F.lit("b"), "rec_id")
    )
    out = link.expand_members(
        matched, pool_a, pool_b, "case_id", ["lead"], ["age", "victim"], "rec_id", "rec_id"
    )
    return out.select("case_id", F.col("rec_id_a").alias("rec_a"), F.col("rec_id_b").alias("rec_b"),
                      "status_a", "status_b", "lead")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_key_report(t):
    return link.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])
