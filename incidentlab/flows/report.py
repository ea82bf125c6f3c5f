"""From cleaned death records to the report's frames and tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import names
from ..clean import label_period
from ..geo import marker_colour
from ..io import export_view
from ..multivalue import abbreviate, collapse_multiple, explode_members, retype_members
from ..ordering import number_global
from ..periods import Policy, annualized, compare_windows, fiscal_label, monthly_counts
from ..rollup import incident_type, known_victims, rollup_incidents, subset
from ..rsem import first_match, known_level, level_rank, matches
from ..tables import (
    breakdown, complete_grid, count_by, coverage, crosstab, period_matrix, row_total, share_table,
    victim_counts, with_share, with_total, year_span,
)

SINGLE_INCIDENT_OFFSET = 100


@dataclass(frozen=True)
class Report:
    """Frames at the person, incident and agency-by-case grain."""

    fatalities: DataFrame
    incidents: DataFrame
    agency_fatalities: DataFrame
    agency_incidents: DataFrame


def classify_deaths(deaths: DataFrame, policy: Policy) -> DataFrame:
    """Eligible deaths with agency type, incident type, cause group and policy period."""
    df = deaths.where(F.col("not_kbp") == 0).withColumns({
        "agency_type": first_match([
            (F.col("agency_type") == "State Police", "WSP"),
            (matches("agency_type", "Other"), "Other"),
        ], F.col("agency_type")),
        "incident_type": incident_type(),
        "traffic": F.when(matches("description", "traffic"), "yes").otherwise("no"),
        "cod3": first_match(
            [(F.col("cod") == v, v) for v in ("Vehicle", "Gunshot")], "Other"
        ),
    })
    df = label_period(df, "date", policy.bounds, dummies=["reform", "rollback"])
    return known_victims(df)


def number_incidents(deaths: DataFrame) -> DataFrame:
    """Fill missing incident numbers with 100 + position in (type descending, date) order.
    Multi-death incidents carry a manual number below 100. ``deaths`` should be a stored
    table: numbering reads its sort columns more than once."""
    order = [
        -level_rank("incident_type", names.INCIDENT_TYPE_LEVELS), F.col("date"), F.col("rec_id")
    ]
    return number_global(deaths, order, "__position").withColumn(
        "incident_num",
        F.coalesce("incident_num", F.col("__position") + SINGLE_INCIDENT_OFFSET),
    ).drop("__position")


def build_incidents(fatalities: DataFrame) -> DataFrame:
    order = [
        -level_rank("incident_type", names.INCIDENT_TYPE_LEVELS), F.col("date"), F.col("rec_id")
    ]
    return rollup_incidents(fatalities, order=order).withColumn(
        "inci_mapcolor", marker_colour()
    )


def agency_cases(cases: DataFrame) -> DataFrame:
    """One row per agency and pursuit case, each typed on its own."""
    return retype_members(explode_members(subset(cases, "pursuit")))


def build(deaths: DataFrame, policy: Policy) -> Report:
    fatalities = classify_deaths(deaths, policy)
    incidents = build_incidents(fatalities)
    return Report(fatalities, incidents, agency_cases(fatalities), agency_cases(incidents))


def _measures(with_victims: bool) -> dict[str, tuple[Column, bool]]:
    kinds = {
        "pursuit_veh_fatalities": (matches("incident_type", "vehicular"), False),
        "after_pursuit_homicides": (matches("incident_type", "homicide"), False),
        "after_pursuit_suicides": (matches("incident_type", "suicide"), False),
    }
    if not with_victims:
        return kinds
    victims = [("subjects", "Subject"), ("bystanders", "Bystander"),
               ("passengers", "Passenger"), ("officers", "Officer")]
    return kinds | {n: (F.col("victim") == v, True) for n, v in victims}


def agency_period_matrix(
    agency_cases: DataFrame, agencies: DataFrame | None = None, grain: str = "fatalities"
) -> DataFrame:
    """One row per agency: counts per period and in total, with the agency's attributes.
    ``grain`` is "fatalities" (with victim groups) or "incidents"."""
    wide = period_matrix(
        agency_cases, "agency", "policy_period", names.PERIODS,
        _measures(grain == "fatalities"), count_name=grain,
        attributes={"agency_type": "agency_type"},
    )
    if agencies is None:
        return wide
    return wide.join(agencies.select("agency", "ORI", "population", "accredited"), "agency", "left")


# --- report tables ---------------------------------------------------------------------


def period_victims(fatalities: DataFrame, part: str = "vehicular") -> DataFrame:
    return victim_counts(subset(fatalities, part), "policy_period")


def reform_comparison(fatalities: DataFrame, policy: Policy, part: str = "vehicular", inclusive: bool = False) -> DataFrame:
    return compare_windows(
        subset(fatalities, part), "date", policy.reform, policy.days["reform"], policy.rollback,
        "victim", names.VICTIM_LEVELS, ("Pre-reform", "Post-reform"), inclusive,
    )


def rollback_comparison(fatalities: DataFrame, policy: Policy, part: str = "vehicular", inclusive: bool = False) -> DataFrame:
    return compare_windows(
        subset(fatalities, part), "date", policy.rollback, policy.days["rollback"], None,
        "victim", names.VICTIM_LEVELS, ("Pre-rollback", "Post-rollback"), inclusive,
    )


def annualized_rates(fatalities: DataFrame, policy: Policy) -> DataFrame:
    return annualized(monthly_counts(subset(fatalities, "vehicular"), "date", policy), policy)


def incident_type_table(incidents: DataFrame) -> DataFrame:
    named = incidents.withColumn(
        "incident_type",
        F.when(matches("incident_type", "All other"), "Vehicle not involved").otherwise(F.col("incident_type")),
    )
    return share_table(named, "incident_type")


def cause_group() -> Column:
    return first_match([
        (F.col("incident_type") == "Pursuit vehicular fatality", "Pursuit vehicular fatality"),
        (F.col("cod") == "Gunshot", "Gunshot"),
        (F.col("cod") == "Taser", "Taser"),
        (matches("cod", "Asphyx"), "Asphyxiated/Restrained"),
    ], "All other causes")


def cause_table(fatalities: DataFrame) -> DataFrame:
    return share_table(fatalities.withColumn("cod_cat", cause_group()), "cod_cat")


def victim_table(fatalities: DataFrame) -> DataFrame:
    return share_table(subset(fatalities, "vehicular"), "victim", digits=0)


def period_breakdown(cases: DataFrame, part: str, cat: str) -> DataFrame:
    return breakdown(subset(cases, part), "policy_period", cat)


def calendar_grid(
    cases: DataFrame, part: str, cat: str, levels: Sequence[str], span: DataFrame | None = None
) -> DataFrame:
    """Counts per calendar year and category, zero-filled over all years on record."""
    years = year_span(cases, "year") if span is None else span
    return complete_grid(count_by(subset(cases, part), "year", cat), years, "year", cat, levels)


def legislative_grid(
    cases: DataFrame, part: str, cat: str, levels: Sequence[str], after: Column
) -> DataFrame:
    """Counts per August-July year and category from the first fully covered year.
    ``after`` is the last day of the partial first year."""
    df = subset(cases, part).where(F.col("date") > after)
    if "leg_year" not in df.columns:
        df = df.withColumn("leg_year", fiscal_label("date"))
    axis = df.select("leg_year").distinct()
    grid = complete_grid(count_by(df, "leg_year", cat), axis, "leg_year", cat, levels)
    return grid.withColumn("leg_year", F.regexp_replace("leg_year", "Aug|Jul", ""))


def agency_breakdown(agency_long: DataFrame, cases: DataFrame, part: str, by: str, cat: str) -> DataFrame:
    """Each agency (or agency type) counted once per case; shares refer to the number of
    cases and so add up to more than one."""
    df = subset(agency_long, part)
    if by == "agency":
        df = df.withColumn("agency", abbreviate("agency", names.AGENCY_ABBREVIATIONS_PLOT))
    return breakdown(df, by, cat, base=row_total(subset(cases, part)))


def grouped_agency_breakdown(cases: DataFrame, part: str, cat: str) -> DataFrame:
    """Cases with several agencies under one label."""
    short = collapse_multiple(abbreviate("agency", names.AGENCY_ABBREVIATIONS_PLOT))
    return breakdown(subset(cases, part).withColumn("agency", short), "agency", cat)


def place_breakdown(
    cases: DataFrame, part: str, place: str, cat: str, min_total: int = 0
) -> DataFrame:
    """By county, city or legislative district."""
    return breakdown(subset(cases, part), place, cat, min_total=min_total)


def coverage_table(fatalities: DataFrame) -> DataFrame:
    reviewed = fatalities.where(F.col("vpursuit") != "Reviewed not related")
    return coverage(reviewed, names.SOURCE_IDS, "year")


def coding_crosstab(fatalities: DataFrame) -> DataFrame:
    known = fatalities.withColumn("vpursuit", known_level("vpursuit", names.CODING_LEVELS))
    return crosstab(known, "vpursuit", "incident_type", names.INCIDENT_TYPE_LEVELS)


def stops_summary(incidents: DataFrame) -> DataFrame:
    """Attempted-stop incidents and how many of them have several deaths."""
    return subset(incidents, "stop").agg(
        F.count(F.lit(1)).alias("incidents"),
        F.count_if(F.col("inci_mapmult") == "mult").alias("multiple"),
    )


def exclusion_summary(deaths: DataFrame, incidents: DataFrame) -> DataFrame:
    """Deaths on file, excluded and included, and the resulting incidents."""
    return deaths.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(F.coalesce(F.col("not_kbp") != 0, F.lit(True))).alias("excluded"),
        F.count_if(F.col("not_kbp") == 0).alias("included"),
    ).withColumn("incidents", row_total(incidents))


def fatalities_export(fatalities: DataFrame, out: str | None = None) -> DataFrame:
    c = F.col
    return export_view(subset(fatalities, "pursuit"), {
        "name": c("name"), "date": c("date"), "victim": c("victim"), "county": c("county"),
        "agency": abbreviate("agency"), "LD": c("district"),
        "incident type": c("incident_type"), "code detail": c("vpursuit"),
        "link to article": c("url_click"),
    }, [c("date").desc(), c("rec_id")], out)


def stops_export(fatalities: DataFrame, out: str | None = None) -> DataFrame:
    c = F.col
    return export_view(subset(fatalities, "stop"), {
        "name": c("name"), "date": c("date"), "victim": c("victim"), "county": c("county"),
        "agency": abbreviate("agency", names.AGENCY_ABBREVIATIONS_STOPS),
        "link to article": c("url_click"),
    }, [c("date").desc(), c("rec_id")], out)


def incidents_export(incidents: DataFrame, out: str | None = None) -> DataFrame:
    c = F.col
    return export_view(subset(incidents, "pursuit"), {
        "Agency": abbreviate("agency"), "Date": c("date"), "LD": c("district"),
        "Fatalities": c("fatalities"), "P/O/B killed": c("pbo_killed"),
        "P/B injured": c("pb_injured"),
    }, out=out)


def period_shares(cases: DataFrame) -> DataFrame:
    """Cases per policy period with their share and a Total row."""
    counts = with_share(count_by(cases, "policy_period"))
    return with_total(counts, "policy_period", ["Number", "Percent"])
