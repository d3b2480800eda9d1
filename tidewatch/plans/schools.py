"""School-year cohort, school and district panels, summary and drill-down tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_date, date_lit, rate, safe_ratio, series_title
from ..operators import (
    canonicalize,
    lag_ratio,
    latest_rows,
    spine_counts,
    trailing_mean,
)
from ..operators.series import Interval, close_open
from ..sources import dense_grid, dimension

# The school year, roles that are not counted, the student ages, the length of the
# two intervals in days and the steps of the incidence columns.
YEAR_START = dt.date(2021, 8, 18)
NOT_COUNTED = ("Volunteer/visitor", "volunteer-visitor")
STUDENT_AGES = (5, 18)
THRESHOLD_DAYS = 7
ACTIVE_DAYS = 10
MEAN_DAYS = 5
RATIO_DAYS = 5

INTERVALS = (
    Interval(
        THRESHOLD_DAYS, "student", "student_out",
        "total_student_cases", "students_after_7", "current_threshold_cases",
    ),
    Interval(ACTIVE_DAYS, "new", "out", "total_cases", "recovered", "active_cases"),
    Interval(
        ACTIVE_DAYS, "st_new", "st_out",
        "total_school_transmitted", "st_recovered", "active_school_transmitted",
    ),
)
SUMMARY = (
    "school",
    "new_student_cases",
    "total_cases",
    "enrollment",
    "current_threshold_cases",
    "percent_of_enrollment",
)
DRILLDOWN = (
    "school",
    "date",
    "new_student_cases",
    "total_student_cases",
    "active_cases",
    "current_threshold_cases",
    "percent_of_enrollment",
    "active_school_transmitted",
    "total_cases",
)


def is_student_age() -> Column:
    return F.col("patient_age_at_event_in_years").between(*STUDENT_AGES)


def is_student_type() -> Column:
    return F.col("corona_pui_col_school_univ_type") == "Student"


def is_school_acquired() -> Column:
    return F.col("corona_pui_col_school_acquired_case") == "Yes"


def k12_cohort(
    linked: DataFrame,
    start: dt.date = YEAR_START,
    districts: DataFrame | None = None,
    aliases: DataFrame | None = None,
) -> DataFrame:
    """School-associated cases since ``start`` with their district and canonical school."""
    spark = linked.sparkSession
    districts = districts or dimension(spark, "exposure_district")
    aliases = aliases or dimension(spark, "school_alias")
    kept = linked.filter(
        (F.col("covid_case_date") >= date_lit(start))
        & ~F.col("corona_pui_col_school_univ_type").isin(*NOT_COUNTED)
    )
    kept = kept.join(
        districts.withColumnRenamed("exposure_district", "exposure_place_school_district"),
        "exposure_place_school_district",
        "inner",
    )
    return canonicalize(kept, "place_name", aliases, "place_name", "school", "school")


def _daily(
    cohort: DataFrame,
    grid: DataFrame,
    entity: str,
    literal: bool,
    student_in: Column,
    student_out: Column,
) -> DataFrame:
    """Entries and exits per grid row; each case becomes its dated events in one pass."""
    zero = F.lit(0)

    def one(p: Column) -> Column:
        return F.when(p, 1).otherwise(0)

    def event(at: Column, **hits: Column) -> Column:
        names = ("student", "student_out", "new", "out", "st_new", "st_out")
        return F.struct(at.alias("date"), *[hits.get(n, zero).alias(n) for n in names])

    case, onset = F.col("covid_case_date"), F.col("patient_event_onset_date")
    acquired = one(is_school_acquired())
    events = [
        event(case, student=one(student_in)),
        event(onset, new=F.lit(1), st_new=acquired),
    ]
    if literal:
        events += [
            event(F.date_add(case, THRESHOLD_DAYS), student_out=one(student_out)),
            event(F.date_add(onset, ACTIVE_DAYS), out=F.lit(1), st_out=acquired),
        ]
    dated = cohort.select(entity, F.inline(F.array(*events)))
    names = [c for c in dated.columns if c not in ("date", entity)]
    return spine_counts(dated, grid, ["date", entity], {n: F.col(n) for n in names})


def _panel(daily: DataFrame, entity: str, literal: bool) -> DataFrame:
    out = close_open(daily, INTERVALS, "date", entity, literal)
    return out.withColumnsRenamed(
        {
            "student": "new_student_cases",
            "new": "new_cases",
            "st_new": "new_school_transmission",
        }
    ).withColumn(
        "percent_of_enrollment",
        safe_ratio("current_threshold_cases", "enrollment", scale=100, digits=2),
    )


def school_panel(
    cohort: DataFrame,
    as_of: dt.date | str,
    start: dt.date = YEAR_START,
    schools: DataFrame | None = None,
    literal: bool = False,
) -> DataFrame:
    """Daily panel of every school: 4 identifying and 17 numeric columns.

    ``literal`` counts recoveries out even when the onset lies before the panel.
    """
    schools = schools or dimension(cohort.sparkSession, "school")
    grid = dense_grid(schools.select("school", "enrollment", "district"), start, as_of)
    student = is_student_age()
    daily = _daily(cohort, grid, "school", literal, student, student)
    out = _panel(daily, "school", literal)
    out = trailing_mean(out, {"new_cases": "five_day_average"}, MEAN_DAYS, "date", "school")
    out = out.withColumn(
        "incidence_per_1000", rate("five_day_average", "enrollment", per=1_000)
    )
    out = lag_ratio(
        out, "incidence_per_1000", RATIO_DAYS, "date", "school", "ratio", "five_day_decrease"
    )
    return out.select(
        "date",
        "school",
        "enrollment",
        "district",
        "new_student_cases",
        "total_student_cases",
        "students_after_7",
        "current_threshold_cases",
        "percent_of_enrollment",
        "new_cases",
        "total_cases",
        "recovered",
        "active_cases",
        "five_day_average",
        "incidence_per_1000",
        "ratio",
        "five_day_decrease",
        "new_school_transmission",
        "total_school_transmitted",
        "st_recovered",
        "active_school_transmitted",
    )


def district_panel(
    cohort: DataFrame,
    as_of: dt.date | str,
    start: dt.date = YEAR_START,
    districts: DataFrame | None = None,
    student: Column | None = None,
    literal: bool = False,
) -> DataFrame:
    """Daily panel of every district in one pass; 16 columns.

    One student rule (the reported role unless given) serves entries and exits. ``literal``
    counts entries by role and exits by age, which can drive the threshold count below zero.
    """
    districts = districts or dimension(cohort.sparkSession, "school_district")
    grid = dense_grid(districts.select("district", "enrollment"), start, as_of)
    student_in = is_student_type() if student is None else student
    student_out = is_student_age() if literal else student_in
    daily = _daily(cohort, grid, "district", literal, student_in, student_out)
    out = _panel(daily, "district", literal)
    return out.withColumnRenamed("district", "school").select(
        "date",
        "new_student_cases",
        "total_student_cases",
        "school",
        "enrollment",
        "new_cases",
        "total_cases",
        "new_school_transmission",
        "total_school_transmitted",
        "students_after_7",
        "current_threshold_cases",
        "percent_of_enrollment",
        "recovered",
        "active_cases",
        "st_recovered",
        "active_school_transmitted",
    )


def latest_summary(
    schools: DataFrame, districts: DataFrame, as_of: dt.date | str
) -> DataFrame:
    """Schools of each district and the district itself on the last panel day."""
    both = _stacked(schools, districts)
    return latest_rows(both, "date", as_date(as_of)).select("district", *SUMMARY, "is_total")


def _stacked(schools: DataFrame, districts: DataFrame) -> DataFrame:
    return schools.withColumn("is_total", F.lit(False)).unionByName(
        districts.withColumn("district", F.col("school")).withColumn("is_total", F.lit(True)),
        allowMissingColumns=True,
    )


def drilldown(
    schools: DataFrame, districts: DataFrame, entity: str | None = None
) -> DataFrame:
    """Daily series behind a summary row; all entities unless one is named."""
    both = _stacked(schools, districts)
    if entity is not None:
        both = both.filter(F.col("school") == entity)
    return both.select(
        *DRILLDOWN, series_title("COVID-19 Progression at", "school").alias("title")
    )
