"""Sources, sinks, projections and filters."""

from pyspark.sql import functions as F

from incidentlab import io
from incidentlab.rollup import subset_tags
from incidentlab.rsem import matches

from .base import SQL_AFTER, SQL_PURSUIT, SQL_VEHICULAR, fatalities, query

ORDER_SCHEMA = """o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double,
 o_orderdate timestamp_ntz, o_orderpriority string"""


@query("""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate,
  o_orderpriority FROM orders
""")
def scan_csv_roundtrip(t):
    path = io.shared_folder(t.spark) + "/orders.csv"
    t.orders.write.option("header", True).csv(path)
    back = io.read_table(t.spark, path, ORDER_SCHEMA)
    return back.withColumn("o_orderdate", F.col("o_orderdate").cast("date"))


@query("""
SELECT o_orderkey, o_totalprice, year(o_orderdate) AS o_year FROM orders
""")
def sink_parquet_roundtrip(t):
    table = t.orders.select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("o_year"))
    paths = io.write_tables({"orders": table}, io.shared_folder(t.spark), {"orders": "o_year"})
    return io.read_table(
        t.spark, paths["orders"], "o_orderkey long, o_totalprice double, o_year int"
    )


@query("SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
def scan_filtered(t):
    return t.nation.where(F.col("n_regionkey") == 1).select("n_name", "n_regionkey")


@query("""
SELECT o_orderkey AS id, year(o_orderdate) AS year, o_orderpriority AS priority,
  CAST(CASE WHEN year(o_orderdate) < 1999 THEN o_totalprice END AS DOUBLE) AS price,
  CASE WHEN year(o_orderdate) >= 1999 THEN o_orderstatus END AS status
FROM orders
""")
def union_harmonized(t):
    """Three yearly layouts: an early one without status, a middle one with the year as
    text, a late one with other column names."""
    year = F.year("o_orderdate")
    early = t.orders.where(year < 1997).select(
        F.col("o_orderkey").alias("id"), year.alias("year"),
        F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"),
    )
    middle = t.orders.where((year >= 1997) & (year < 1999)).select(
        F.col("o_orderkey").alias("id"), year.cast("string").alias("year"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").cast("string").alias("price"),
    )
    late = t.orders.where(year >= 1999).select(
        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"),
        year.alias("year"), F.col("o_orderkey").alias("id"),
    )
    return io.union_sources([early, middle, late], {"year": "int", "price": "double"}).select(
        "id", "year", "priority", "price", "status"
    )


@query("""
SELECT o_orderkey AS "order no", strftime(o_orderdate, '%m/%d/%y') AS "date", o_totalprice AS price FROM orders
""")
def export_table(t):
    return io.export_view(
        t.orders,
        {"order no": F.col("o_orderkey"), "date": F.date_format("o_orderdate", "MM/dd/yy"),
         "price": F.col("o_totalprice")},
        [F.col("o_orderdate").desc(), F.col("o_orderkey")],
    )


@query("""
SELECT CAST(n_nationkey AS INT) AS "no", n_name AS "nation name", r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def export_csv_roundtrip(t):
    """The CSV side of an export, read back."""
    path = io.shared_folder(t.spark) + "/nations.csv"
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    io.export_view(
        places, {"no": F.col("n_nationkey"), "nation name": F.col("n_name"), "region": F.col("r_name")},
        [F.col("r_name"), F.col("n_nationkey")], out=path,
    )
    return io.read_table(t.spark, path, "no int, `nation name` string, region string")


@query("""
SELECT c_custkey AS "custkey.cust", c_name AS "name.cust", n_name AS nation,
  CAST(trunc(c_acctbal) AS INT) AS balance, TRY_CAST(c_mktsegment AS INT) AS segment_no
FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def project_rename(t):
    """Bulk suffix for a name pattern, lower-casing, range drop and safe numeric casts."""
    cust = t.customer.withColumnsRenamed(
        {c: c.upper() for c in t.customer.columns}
    )
    cust = cust.withColumnsRenamed({c: c.lower() for c in cust.columns})
    cust = cust.withColumnsRenamed(
        {c: c.removeprefix("c_") + ".cust" for c in cust.columns if c in ("c_custkey", "c_name")}
    )
    joined = cust.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    keep = [f"`{c}`" for c in joined.columns if c.endswith(".cust")]
    return joined.select(
        *keep, F.col("n_name").alias("nation"),
        F.col("c_acctbal").try_cast("int").alias("balance"),
        F.col("c_mktsegment").try_cast("int").alias("segment_no"),
    )


@query("""
SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem
WHERE (NULLIF(l_linenumber, 3) IS NULL OR l_returnflag IN ('A', 'R')) AND l_quantity >= 25 AND l_discount > 0
""")
def filter_predicates(t):
    ptype = F.nullif("l_linenumber", F.lit(3))
    return t.lineitem.where(
        (ptype.isNull() | F.col("l_returnflag").isin("A", "R"))
        & (F.col("l_quantity") >= 25) & (F.col("l_discount") > 0)
    ).select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")


@query("""
SELECT p_partkey, p_name,
  CAST(coalesce(regexp_matches(NULLIF(p_type, 'PROMO'), 'ECO|STAND'), false) AS INT) AS included
FROM part WHERE NOT coalesce(regexp_matches(NULLIF(p_type, 'PROMO'), 'MEDIUM|LARGE'), false)
""")
def filter_regex(t):
    kind = F.nullif("p_type", F.lit("PROMO"))
    return t.part.where(~matches(kind, "MEDIUM|LARGE")).select(
        "p_partkey", "p_name", matches(kind, "ECO|STAND").cast("int").alias("included")
    )


@query(f"""
SELECT 'all' AS subset, count(*) AS persons, count(DISTINCT case_id) AS incidents FROM fatalities
UNION ALL SELECT 'pursuit', count(*), count(DISTINCT case_id) FROM fatalities WHERE {SQL_PURSUIT}
UNION ALL SELECT 'vehicular', count(*), count(DISTINCT case_id) FROM fatalities WHERE {SQL_VEHICULAR}
UNION ALL SELECT 'after', count(*), count(DISTINCT case_id) FROM fatalities WHERE {SQL_AFTER}
UNION ALL SELECT 'stop', count(*), count(DISTINCT case_id) FROM fatalities WHERE regexp_matches(incident_type, 'stop')
""", "fatalities")
def subset_counts(t):
    """Persons and incidents of each nested subset in one pass: persons per incident first,
    then one array of tags per incident."""
    people = fatalities(t).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("incident_type").alias("incident_type"))
    per_incident = people
    tags = F.array_compact(F.array(*[F.when(cond, name) for name, cond in subset_tags().items()]))
    return per_incident.select("n", F.explode(tags).alias("subset")).groupBy("subset").agg(
        F.sum("n").alias("persons"), F.count(F.lit(1)).alias("incidents")
    )
