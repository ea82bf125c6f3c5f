"""State-plane coordinates."""

from pyspark.sql import functions as F

from incidentlab import geo
from incidentlab.rollup import first_by

from .base import query

# The cone's constants, worked out in SQL from the published parameters of the plane: NAD83,
# Washington South, standard parallels 45 50' and 47 20', origin 45 20' N 120 30' W, US survey feet.
CONE_SQL = """
p AS (SELECT radians(45 + 50 / 60e0) AS p1, radians(47 + 20 / 60e0) AS p2, radians(45 + 20 / 60e0) AS p0,
  sqrt(2 / 298.257222101e0 - 1 / (298.257222101e0 * 298.257222101e0)) AS ec),
q AS (SELECT ec, cos(p1) / sqrt(1 - pow(ec * sin(p1), 2)) AS m1, cos(p2) / sqrt(1 - pow(ec * sin(p2), 2)) AS m2,
  tan(pi() / 4 - p1 / 2) / pow((1 - ec * sin(p1)) / (1 + ec * sin(p1)), ec / 2) AS t1,
  tan(pi() / 4 - p2 / 2) / pow((1 - ec * sin(p2)) / (1 + ec * sin(p2)), ec / 2) AS t2,
  tan(pi() / 4 - p0 / 2) / pow((1 - ec * sin(p0)) / (1 + ec * sin(p0)), ec / 2) AS t0 FROM p),
c AS (SELECT *, ln(m1 / m2) / ln(t1 / t2) AS cone FROM q),
k AS (SELECT ec, cone, 6378137e0 * m1 / (cone * pow(t1, cone)) AS scale,
  6378137e0 * m1 / (cone * pow(t1, cone)) * pow(t0, cone) AS rho0 FROM c)"""


def _latitude_sql(steps: int) -> str:
    """The iterative form of the inverse, as an independent check on the series."""
    sql = "SELECT *, pi() / 2 - 2 * atan(t) AS phi FROM t"
    for _ in range(steps):
        sql = f"SELECT * REPLACE (pi() / 2 - 2 * atan(t * pow((1 - ec * sin(phi)) / (1 + ec * sin(phi)), ec / 2)) AS phi) FROM ({sql})"
    return sql


@query(f"""
WITH first_line AS (SELECT l_orderkey, l_suppkey, l_partkey FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1),
xy AS (SELECT l_orderkey AS incident, 900000 + 1000e0 * (l_suppkey % 1000) AS x, 300000 + 50e0 * (l_partkey % 9000) AS y FROM first_line),
{CONE_SQL.strip()},
m AS (SELECT incident, ec, cone, scale, x * (1200e0 / 3937e0) - 500000e0 AS e, rho0 - y * (1200e0 / 3937e0) AS n FROM xy, k),
t AS (SELECT *, pow(sqrt(e * e + n * n) / scale, 1 / cone) AS t FROM m),
ll AS (SELECT incident, degrees(atan2(e, n) / cone) - 120.5e0 AS longitude, degrees(phi) AS latitude FROM ({_latitude_sql(6)}))
SELECT incident, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude,
  round((SELECT avg(longitude) FROM ll), 6) AS mean_lon, round((SELECT avg(latitude) FROM ll), 6) AS mean_lat FROM ll
""")
def geo_project(t):
    """One point per incident, in degrees, with the centroid of all points."""
    lines = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (900000 + 1000.0 * (F.col("l_suppkey") % 1000)).alias("x"),
        (300000 + 50.0 * (F.col("l_partkey") % 9000)).alias("y"),
    )
    one = first_by(lines, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], ["x", "y"])
    points = geo.project_points(one, "x", "y")
    mean = geo.centroid(points).select(F.struct("lon", "lat").alias("p")).scalar()
    return points.select(
        F.col("l_orderkey").alias("incident"),
        F.round("longitude", 6).alias("longitude"), F.round("latitude", 6).alias("latitude"),
        F.round(mean["lon"], 6).alias("mean_lon"),
        F.round(mean["lat"], 6).alias("mean_lat"),
    )
