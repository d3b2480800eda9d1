"""Surveillance jobs: each takes frames and a run date and returns lazy result tables."""

from .batches import nightly_tables, run_nightly, run_schools, school_tables
from .charts import CHARTS, chart_tables
from .coverage import coverage_panel
from .extracts import (
    clean_case_extract,
    clean_death_extract,
    clean_dose_extract,
    clean_investigations,
    clean_test_extract,
    link_collection_date,
)
from .lists import (
    adults_to_reroute,
    case_notices,
    line_list,
    minors_delta,
    missing_school,
    school_slice,
    uninvestigated_minors,
)
from .panels import (
    cases_daily,
    cases_weekly,
    city_daily,
    deaths_monthly,
    deaths_weekly,
    hospital_weekly,
    positivity_daily,
)
from .schools import district_panel, drilldown, k12_cohort, latest_summary, school_panel
from .scorecards import dose_scorecard, labelled, regional_scorecard

__all__ = [
    "CHARTS",
    "adults_to_reroute",
    "case_notices",
    "cases_daily",
    "cases_weekly",
    "chart_tables",
    "city_daily",
    "clean_case_extract",
    "clean_death_extract",
    "clean_dose_extract",
    "clean_investigations",
    "clean_test_extract",
    "coverage_panel",
    "deaths_monthly",
    "deaths_weekly",
    "district_panel",
    "dose_scorecard",
    "drilldown",
    "hospital_weekly",
    "k12_cohort",
    "labelled",
    "latest_summary",
    "line_list",
    "link_collection_date",
    "minors_delta",
    "missing_school",
    "nightly_tables",
    "run_nightly",
    "run_schools",
    "positivity_daily",
    "regional_scorecard",
    "school_panel",
    "school_slice",
    "school_tables",
    "uninvestigated_minors",
]
