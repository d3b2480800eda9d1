"""Line lists: notices, 14-day lists, follow-up work and single-school slices."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import date_lit, first_match, is_blank, yes_no_unknown
from ..operators import distinct_on, map_codes, once_only, trailing_days
from ..sources import dimension
from .schools import NOT_COUNTED, YEAR_START

# Days added to the collection or onset date, the window of the line list, the
# renamed schools, the dates and places of the follow-up lists.
ISOLATE_DAYS = 5
RETURN_DAYS = 6
LIST_DAYS = 13
INFECTIOUS_BEFORE = 2
INFECTIOUS_AFTER = 10
RENAMED_SCHOOLS = ("Thomas Edison North", "Thomas Edison South")
FOLLOWUP_START = dt.date(2021, 8, 30)
MINOR_AGES = (5, 17)
ADULT_BORN_BY = dt.date(2003, 11, 2)
ADULT_CASES_FROM = dt.date(2021, 11, 5)
OTHER_INVESTIGATOR = "Utah State"
ADULT_DISTRICTS_LEFT_OUT = (
    "Thomas Edison Charter Schools South",
    "Thomas Edison Charter School South",
)

NOTICE = (
    "first_name",
    "last_name",
    "dob",
    "school_type",
    "school_type_detail",
    "school",
    "test_collection_date",
    "isolate_through",
    "can_return_on",
)
LINE_LIST = (
    "first_name",
    "last_name",
    "dob",
    "test_report_date",
    "school_type",
    "school_type_detail",
    "school",
    "district",
    "symptoms",
    "onset_date",
    "infectious_start_date",
    "contact_tracing_needed",
    "tracing_details",
    "extracurriculars",
    "ext_other",
    "bus",
    "isolate_through",
)
MINOR = (
    "patient_record_number",
    "person_last_name",
    "person_first_name",
    "first_positive_lab",
    "patient_birth_date",
    "address_at_diagnosis_county",
    "address_at_diagnosis_city",
)
SLICE = (
    "patient_record_number",
    "patient_birth_date",
    "covid_case_date",
    "patient_event_onset_date",
    "person_first_name",
    "person_last_name",
)
RENAMES = {
    "person_first_name": "first_name",
    "person_last_name": "last_name",
    "patient_birth_date": "dob",
    "corona_pui_col_school_univ_type": "school_type",
    "corona_pui_col_school_univ_type_details": "school_type_detail",
    "first_positive_lab": "test_collection_date",
    "covid_case_date": "test_report_date",
    "patient_event_onset_date": "onset_date",
    "corona_pui_col_school_univ_event": "contact_tracing_needed",
    "corona_pui_col_school_univ_event_details": "tracing_details",
    "corona_pui_col_school_univ_activity": "extracurriculars",
    "corona_pui_col_school_univ_activities_details": "ext_other",
    "corona_pui_col_school_univ_bus_details": "bus",
}


def to_recipients(cohort: DataFrame, recipients: DataFrame | None = None) -> DataFrame:
    """Each case once per recipient: its district, its school, or both."""
    recipients = recipients or dimension(cohort.sparkSession, "recipient")
    out = cohort
    for kind in ("district", "school"):
        listed = recipients.filter(F.col("kind") == kind)
        out = map_codes(out, kind, listed, "value", "recipient", f"_{kind}")
    out = out.withColumn("recipient", F.explode(F.array("_district", "_school")))
    return out.filter(F.col("recipient").isNotNull()).drop("_district", "_school")


def case_notices(new_cases: DataFrame, recipients: DataFrame | None = None) -> DataFrame:
    """Isolation notices for new cases; the school is named as it was reported."""
    sent = to_recipients(new_cases, recipients).withColumn("school", F.col("place_name"))
    return (
        sent.withColumnsRenamed(RENAMES)
        .withColumns(
            {
                "isolate_through": F.date_add("test_collection_date", ISOLATE_DAYS),
                "can_return_on": F.date_add("test_collection_date", RETURN_DAYS),
            }
        )
        .select("recipient", *NOTICE)
    )


def line_list(
    cohort: DataFrame,
    as_of: dt.date | str,
    recipients: DataFrame | None = None,
    days: int = LIST_DAYS,
    keep_null: bool = False,
) -> DataFrame:
    """Cases of the last two weeks per recipient with symptoms and infectious period.

    ``keep_null`` leaves a missing symptom answer missing instead of ``Unknown``.
    """
    recent = to_recipients(trailing_days(cohort, "covid_case_date", as_of, days), recipients)
    named = F.when(F.col("school").isin(*RENAMED_SCHOOLS), F.col("school"))
    return (
        recent.withColumn("school", F.coalesce(named, "place_name"))
        .withColumnsRenamed(RENAMES)
        .withColumns(
            {
                "symptoms": yes_no_unknown("corona_pui_col_covid_sympt", keep_null),
                "isolate_through": F.date_add("onset_date", INFECTIOUS_AFTER),
                "infectious_start_date": F.date_sub("onset_date", INFECTIOUS_BEFORE),
            }
        )
        .select("recipient", *LINE_LIST)
    )


def uninvestigated_minors(linked: DataFrame) -> DataFrame:
    """Minors whose school is not known yet, by area, in one pass over the cases."""
    day, county = F.col("covid_case_date"), F.col("address_at_diagnosis_county")
    city = F.col("address_at_diagnosis_city")
    year, followup = date_lit(YEAR_START), date_lit(FOLLOWUP_START)
    area = first_match(
        [
            ((county == "BE") & (day >= followup), "box_elder"),
            ((county == "CA") & (city != "Logan") & (day >= year), "cache"),
            ((county == "CA") & (city == "Logan") & (day >= year), "logan"),
            ((county == "RI") & (day >= followup), "rich"),
        ]
    )
    return (
        linked.filter(
            F.col("patient_age_at_event_in_years").between(*MINOR_AGES)
            & (day >= year)
            & (F.col("place_name") == "")
        )
        .withColumn("area", area)
        .filter(F.col("area").isNotNull())
        .select("area", *MINOR)
    )


def minors_delta(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Records on only one of the two lists of an area."""
    return once_only(current, previous, ["area", "patient_record_number"])


def missing_school(linked: DataFrame, since: dt.date = FOLLOWUP_START) -> DataFrame:
    """School-associated cases without a school name."""
    return linked.filter(
        (F.col("covid_case_date") >= date_lit(since))
        & (F.col("corona_pui_col_school_univ") == "Yes")
        & is_blank("place_name")
    )


def adults_to_reroute(
    linked: DataFrame,
    born_by: dt.date = ADULT_BORN_BY,
    since: dt.date = ADULT_CASES_FROM,
    investigator: str = OTHER_INVESTIGATOR,
    districts: DataFrame | None = None,
) -> DataFrame:
    """Adult school cases another office holds and has not interviewed, one row per record."""
    districts = districts or dimension(linked.sparkSession, "exposure_district").filter(
        ~F.col("exposure_district").isin(*ADULT_DISTRICTS_LEFT_OUT)
    )
    place = F.col("exposure_place_school_district")
    pending = linked.filter(
        (F.col("patient_jurisdiction_of_investigation") == investigator)
        & (F.col("covid_interview_complete") == "f")
        & (F.col("corona_pui_col_school_univ") == "Yes")
        & (F.col("patient_birth_date") <= date_lit(born_by))
        & (F.col("covid_case_date") >= date_lit(since))
        & ~F.col("corona_pui_col_school_univ_type").isin(*NOT_COUNTED)
    )
    # A blank district is admitted too.
    admitted = districts.select(
        F.col("exposure_district").alias("exposure_place_school_district")
    )
    kept = pending.filter(place != "").join(
        admitted, "exposure_place_school_district", "left_semi"
    )
    kept = kept.select(*pending.columns).unionByName(pending.filter(place == ""))
    # The earliest case of a record; rows that tie in the columns listed are equal in the result.
    return distinct_on(kept.select(*SLICE), "patient_record_number", ["covid_case_date", *SLICE])


def school_slice(
    cohort: DataFrame,
    places: Sequence[str],
    as_of: dt.date | str | None = None,
    days: int = LIST_DAYS,
    cols: Sequence[str | Column] = SLICE,
) -> DataFrame:
    """Cases of one school under any of its reported names; all dates without ``as_of``."""
    out = cohort.filter(F.col("place_name").isin(*places))
    if as_of is not None:
        out = trailing_days(out, "covid_case_date", as_of, days)
    return out.select(*cols)
