"""The two batch runs: dictionaries of tables for ``sources.publish``, and runners that publish."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import new_records, symmetric_delta
from ..session import clear_staged
from ..session import stage as stage_frame
from ..sources import commit_snapshot, publish, read_snapshot, write_by_recipient
from ..sources.dimensions import dimension_table
from . import coverage, extracts, lists, panels, schools, scorecards

HOSPITAL_DELTA = (
    "patient_record_number",
    "hosp_admit_date",
    "first_positive_lab",
    "condition_caused_death",
    "covid_death",
)


def nightly_tables(
    inputs: Mapping[str, DataFrame],
    as_of: dt.date | str,
    home: str,
    previous_hospital: DataFrame | None = None,
    stage: Callable[[DataFrame], DataFrame] | None = stage_frame,
    tiebreak: tuple[str, ...] = (),
) -> dict[str, DataFrame]:
    """Panels, scorecards and the hospital delta.

    ``inputs``: ``cases``, ``deaths``, ``tests`` (by collection date), ``daytests`` (by case
    date), ``doses`` and ``investigations``. Each is read once: ``stage`` writes out the cleaned
    extracts and the panels that the scorecards are made of (``None`` recomputes them instead).
    """
    stage = stage or (lambda df: df)
    cases = stage(extracts.clean_case_extract(inputs["cases"]))
    deaths = stage(extracts.clean_death_extract(inputs["deaths"]))
    person = extracts.clean_test_extract(inputs["tests"], "collect_date_fillrph")
    daily_tests = extracts.clean_test_extract(inputs["daytests"], "case_date")
    doses = extracts.clean_dose_extract(inputs["doses"])
    investigations = extracts.clean_investigations(inputs["investigations"], home, tiebreak)

    out = {
        "deaths_weekly": panels.deaths_weekly(deaths, as_of),
        "deaths_monthly": panels.deaths_monthly(deaths),
        "hospital_weekly": panels.hospital_weekly(cases, as_of),
        "cases_daily": stage(panels.cases_daily(cases, as_of)),
        "cases_weekly": stage(panels.cases_weekly(cases, as_of)),
        "city_daily": panels.city_daily(stage(investigations), as_of),
        "positivity_person": panels.positivity_daily(
            stage(person), "collect_date_fillrph", as_of, home
        ),
        "positivity_test": stage(
            panels.positivity_daily(stage(daily_tests), "case_date", as_of, home)
        ),
        "coverage": stage(coverage.coverage_panel(doses, as_of, home)),
    }
    out["scorecard"] = scorecards.regional_scorecard(
        deaths, cases, out["cases_weekly"], out["cases_daily"], out["positivity_test"]
    )
    out["dose_scorecard"] = scorecards.dose_scorecard(out["coverage"], as_of)
    if previous_hospital is not None:
        hospital = cases.filter(F.col("hosp") == "Yes")
        out["hospital_delta"] = symmetric_delta(
            hospital, previous_hospital, "patient_record_number"
        ).select(*HOSPITAL_DELTA)
    return out


def school_tables(
    investigations: DataFrame,
    cases: DataFrame,
    as_of: dt.date | str,
    home: str,
    previous_cohort: DataFrame | None = None,
    previous_minors: DataFrame | None = None,
    stage: Callable[[DataFrame], DataFrame] | None = stage_frame,
    literal: bool = False,
    tiebreak: tuple[str, ...] = (),
) -> dict[str, DataFrame]:
    """Cohort, panels, summaries and line lists of the school batch.

    The cleaned and the linked cases, the cohort, the panels and the list of minors feed several of
    these tables; ``stage`` computes each once (``None`` recomputes them instead).
    """
    stage = stage or (lambda df: df)
    cleaned = stage(extracts.clean_investigations(investigations, home, tiebreak))
    lab = stage(cases.select(*extracts.LAB_COLUMNS))
    linked = stage(extracts.link_collection_date(lab, cleaned))
    cohort = stage(schools.k12_cohort(linked))
    by_school = stage(schools.school_panel(cohort, as_of, literal=literal))
    by_district = stage(schools.district_panel(cohort, as_of, literal=literal))
    minors = stage(lists.uninvestigated_minors(linked))
    out = {
        "cohort": cohort,
        "school_panel": by_school,
        "district_panel": by_district,
        "latest_summary": schools.latest_summary(by_school, by_district, as_of),
        "drilldown": schools.drilldown(by_school, by_district),
        "line_list": lists.line_list(cohort, as_of),
        "minors": minors,
        "missing_school": lists.missing_school(linked),
        "adults_to_reroute": lists.adults_to_reroute(linked),
    }
    if previous_cohort is not None:
        out["cohort_delta"] = symmetric_delta(cohort, previous_cohort, "patient_record_number")
        out["new_cases"] = new_records(cohort, previous_cohort, "patient_record_number")
        out["notices"] = lists.case_notices(out["new_cases"])
    if previous_minors is not None:
        out["minors_delta"] = lists.minors_delta(minors, previous_minors)
    return out


# Every published table is clustered by its entity and then its date, or by what identifies its rows,
# so that a drill-down skips files and row groups and two versions can be compared line by line.
_CASE = ("patient_record_number", "covid_case_date")
PUBLISHED_ORDER = {
    "deaths_weekly": ("region", "week_of"),
    "deaths_monthly": ("month",),
    "hospital_weekly": ("region", "week_of"),
    "cases_daily": ("region", "date"),
    "cases_weekly": ("region", "week_of"),
    "city_daily": ("city", "date"),
    "positivity_person": ("region", "date"),
    "positivity_test": ("region", "date"),
    "coverage": ("region", "dose", "band", "date"),
    "scorecard": ("position",),
    "dose_scorecard": ("position",),
    "hospital_delta": ("patient_record_number", "hosp_admit_date"),
    "cohort": ("exposure_place_school_district", "place_name", *_CASE),
    "school_panel": ("school", "date"),
    "district_panel": ("school", "date"),
    "latest_summary": ("district", "is_total", "school"),
    "drilldown": ("school", "date"),
    "line_list": ("recipient", "school", "last_name", "first_name", "dob"),
    "minors": ("area", "patient_record_number"),
    "missing_school": _CASE,
    "adults_to_reroute": _CASE,
    "cohort_delta": _CASE,
    "new_cases": _CASE,
    "notices": ("recipient",),
    "minors_delta": ("area", "patient_record_number"),
}


def run_nightly(
    inputs: Mapping[str, DataFrame],
    as_of: dt.date | str,
    home: str,
    base: str,
    snapshots: str,
    lang: str = "en",
) -> dict[str, str]:
    """Compute and publish the nightly tables, then commit the hospital snapshot.

    The snapshot is committed only after everything is published, so a failed run can be repeated
    against the same previous one.
    """
    spark = inputs["cases"].sparkSession
    hospital = extracts.clean_case_extract(inputs["cases"]).filter(F.col("hosp") == "Yes")
    try:
        before = read_snapshot(spark, f"{snapshots}/hospital", as_of, hospital.schema)
        tables = nightly_tables(inputs, as_of, home, before)
        written = publish(tables, base, as_of, lang, PUBLISHED_ORDER)
        commit_snapshot(hospital, f"{snapshots}/hospital", as_of)
    finally:
        clear_staged(spark)
    return written


def run_schools(
    investigations: DataFrame,
    cases: DataFrame,
    as_of: dt.date | str,
    home: str,
    base: str,
    snapshots: str,
    lang: str = "en",
) -> dict[str, str]:
    """Compute and publish the school tables and the recipients' files, then commit both snapshots."""
    spark = cases.sparkSession
    try:
        tables = school_tables(investigations, cases, as_of, home)
        kept = {name: tables[name] for name in ("cohort", "minors")}
        before = {
            name: read_snapshot(spark, f"{snapshots}/{name}", as_of, df.schema)
            for name, df in kept.items()
        }
        key = "patient_record_number"
        tables["cohort_delta"] = symmetric_delta(kept["cohort"], before["cohort"], key)
        tables["new_cases"] = stage_frame(new_records(kept["cohort"], before["cohort"], key))
        tables["notices"] = lists.case_notices(tables["new_cases"])
        tables["minors_delta"] = lists.minors_delta(kept["minors"], before["minors"])
        written = publish(tables, base, as_of, lang, PUBLISHED_ORDER)
        names = sorted({r["recipient"] for r in dimension_table("recipient").to_pylist()})
        for name in ("notices", "line_list"):
            rows = spark.read.parquet(written[name])
            write_by_recipient(rows, f"{base}/{lang}/recipients/{name}", recipients=names)
        for name in kept:
            commit_snapshot(spark.read.parquet(written[name]), f"{snapshots}/{name}", as_of)
    finally:
        clear_staged(spark)
    return written
