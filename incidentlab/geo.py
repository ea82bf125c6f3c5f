"""State-plane coordinates to degrees, and map marker attributes."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rsem import ColumnLike, as_column, first_match, matches, paste

US_SURVEY_FOOT = 1200.0 / 3937.0


@dataclass(frozen=True)
class LambertConic:
    """Lambert conformal conic with two standard parallels (degrees, metres)."""

    lat1: float
    lat2: float
    lat0: float
    lon0: float
    false_easting: float
    false_northing: float = 0.0
    semi_major: float = 6378137.0
    inverse_flattening: float = 298.257222101
    unit: float = US_SURVEY_FOOT

    def constants(self) -> tuple[float, float, float, float]:
        """Eccentricity, cone constant, scaled radius factor and radius at the origin."""
        f = 1 / self.inverse_flattening
        e = math.sqrt(2 * f - f * f)

        def m(phi: float) -> float:
            return math.cos(phi) / math.sqrt(1 - (e * math.sin(phi)) ** 2)

        def t(phi: float) -> float:
            s = e * math.sin(phi)
            return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (e / 2)

        p1, p2, p0 = (math.radians(v) for v in (self.lat1, self.lat2, self.lat0))
        n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
        scale = self.semi_major * m(p1) / (n * t(p1) ** n)
        return e, n, scale, scale * t(p0) ** n


# NAD83 Washington South, US survey feet (EPSG:2286).
WASHINGTON_SOUTH_FT = LambertConic(
    lat1=45 + 50 / 60, lat2=47 + 20 / 60, lat0=45 + 20 / 60, lon0=-120.5, false_easting=500000.0
)


def lcc_inverse(
    x: ColumnLike, y: ColumnLike, params: LambertConic = WASHINGTON_SOUTH_FT
) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees from projected coordinates, as plain column
    arithmetic. The latitude comes from the series in the conformal latitude (USGS PP 1395,
    eq. 3-5), good to about 1e-10 rad; the NAD83-WGS84 shift is taken as zero."""
    e, n, scale, rho0 = params.constants()
    easting = as_column(x) * params.unit - params.false_easting
    northing = rho0 - (as_column(y) * params.unit - params.false_northing)
    rho = F.sqrt(easting * easting + northing * northing) * math.copysign(1.0, n)
    chi = F.lit(math.pi / 2) - 2 * F.atan(F.pow(rho / scale, F.lit(1 / n)))
    e2, e4, e6, e8 = e**2, e**4, e**6, e**8
    lat = (
        chi
        + (e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360) * F.sin(2 * chi)
        + (7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520) * F.sin(4 * chi)
        + (7 * e6 / 120 + 81 * e8 / 1120) * F.sin(6 * chi)
        + (4279 * e8 / 161280) * F.sin(8 * chi)
    )
    lon = F.degrees(F.atan2(easting, northing) / n) + params.lon0
    return lon, F.degrees(lat)


def project_points(
    df: DataFrame, x: str, y: str, params: LambertConic = WASHINGTON_SOUTH_FT
) -> DataFrame:
    lon, lat = lcc_inverse(x, y, params)
    return df.withColumns({"longitude": lon, "latitude": lat})


def centroid(df: DataFrame) -> DataFrame:
    """Mean longitude and latitude, a sanity check on the projection."""
    return df.agg(F.avg("longitude").alias("lon"), F.avg("latitude").alias("lat"))


def marker_colour(strict: bool = False) -> Column:
    """Red when passengers, bystanders or officers died, blue when only subjects did, green
    and beige after a pursuit. ``strict=True`` colours exactly one such death red and leaves
    more than one uncoloured."""
    killed = F.col("pbo_killed")
    fatality = matches("incident_type", "fatality")
    return first_match(
        [
            (fatality & ((killed == 1) if strict else (killed >= 1)), "red"),
            (fatality & (killed == 0), "blue"),
            (matches("incident_type", "homicide"), "green"),
            (matches("incident_type", "suicide"), "beige"),
        ]
    )


def marker_label() -> Column:
    """Hover text of a marker."""
    return paste(
        F.lit("fatalities:"), "fatalities", F.lit("<br>"),
        F.lit("injuries:"), "total_injuries", F.lit("<br>"),
        F.lit("by"), "agency", F.lit("<br>"),
        F.lit("date: "), F.date_format("date", "MM/dd/yy"),
        sep=" ",
    )


def markers(incidents: DataFrame, strict: bool = False) -> DataFrame:
    """Marker table of the incident map."""
    return incidents.withColumns({
        "inci_mapcolor": marker_colour(strict),
        "marker_label": marker_label(),
    })
