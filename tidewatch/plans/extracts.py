"""Cleaning of the line-level extracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import (
    bucketize,
    dominant_category,
    epi_week,
    epi_year,
    first_match,
    flag_any,
    month_floor,
    normalize_text,
    override_if_in,
    week_floor,
)
from ..operators import (
    dedupe_by_priority,
    fill_blank,
    link_records,
    parse_dates,
    parse_ints,
)
from ..sources.dimensions import dimension_table
from ..sources.extracts import INPUT_ORDER

# Visit types in order of preference, age bands (upper bound exclusive), the test
# results and type that count, and the campus postcodes merged into the city's.
VISIT_ORDER = ("Inpatient", "Outpatient", "Unknown")
AGE_UPPER = (10, 18, 26, 36, 46, 56, 66, 76, 86, 120)
AGE_LABELS = (
    "0-9", "10-17", "18-25", "26-35", "36-45", "46-55", "56-65", "66-75", "76-85", "86+",
)
TEST_RESULTS = ("POSITIVE", "NEGATIVE")
TEST_TYPE = "PCR/amplification"
CAMPUS_ZIPCODES = ("84322", "84323")
CITY_ZIPCODE = "84321"
HISPANIC = "Hispanic or Latino"


def city_rules() -> list[tuple[str, str]]:
    rows = dimension_table("city_rule").sort_by("rule").to_pylist()
    return [(r["pattern"], r["city"]) for r in rows]


def _with_county(df: DataFrame) -> DataFrame:
    codes = dimension_table("county").to_pylist()
    name = first_match([(F.col("county") == r["code"], r["county"]) for r in codes], "")
    return df.withColumn("county_name", name)


def clean_case_extract(cases: DataFrame) -> DataFrame:
    """Dates parsed, week columns and county names added, missing text blank."""
    dates = ["case_date", "hosp_admit_date", "first_positive_lab"]
    out = parse_ints(
        parse_dates(cases, [c for c in dates if c in cases.columns]), ["county", "lhd"]
    )
    return fill_blank(
        _with_county(
            out.withColumns(
                {
                    "case_week": week_floor("case_date"),
                    "hosp_week": week_floor("hosp_admit_date"),
                }
            )
        )
    )


def clean_death_extract(deaths: DataFrame) -> DataFrame:
    """As for cases; the week is that of the death, the month that of the case."""
    out = parse_ints(parse_dates(deaths, ["date_of_death", "case_date"]), ["county", "lhd"])
    return fill_blank(
        _with_county(
            out.withColumns(
                {
                    "death_week": week_floor("date_of_death"),
                    "death_month": month_floor("case_date"),
                }
            )
        )
    )


def clean_test_extract(tests: DataFrame, date: str) -> DataFrame:
    """Amplification tests with a definite result."""
    kept = tests.filter(
        F.col("test_result").isin(*TEST_RESULTS) & (F.col("test_type") == TEST_TYPE)
    )
    return fill_blank(parse_dates(kept, [date]))


def clean_dose_extract(doses: DataFrame) -> DataFrame:
    """Postcode merged, ethnicity and race combined; ages stay numeric, postcodes are text."""
    numbers = ["dose_all", "age_original"]
    out = parse_ints(parse_dates(doses, ["vaccine_date"]), numbers).withColumns(
        {
            "zipcode": F.col("zipcode").cast("string"),
            "zipcode_map": override_if_in(
                F.col("zipcode").cast("string"), CAMPUS_ZIPCODES, CITY_ZIPCODE
            ),
            "race_eth": dominant_category("ethnicity", HISPANIC, "race"),
        }
    )
    return fill_blank(out)


def age_band(c: str | Column) -> Column:
    return bucketize(c, AGE_UPPER, AGE_LABELS)


def clean_investigations(
    investigations: DataFrame, home: str, tiebreak: tuple[str, ...] = ()
) -> DataFrame:
    """Confirmed cases and deaths of the home jurisdiction, one row per record.

    An inpatient record wins over other visit types. Ties follow ``tiebreak``; without one, extracts
    read with ``input_order=True`` keep the first of equals as the files have them, and others go
    by row content. The input order itself is dropped.
    """
    residence = F.col("patient_jurisdiction_of_residence")
    # On the columns as they are read, so that the filter reaches the scan; blanks are filled after.
    kept = fill_blank(
        investigations.filter(
            (residence.isNull() | residence.isin(home, ""))
            & (
                (F.col("patient_state_case_status") == "Confirmed")
                | (F.col("condition_caused_death") == "Yes")
            )
        )
    )
    if not tiebreak and INPUT_ORDER in kept.columns:
        tiebreak = (INPUT_ORDER,)
    dates = [
        c
        for c in (
            "covid_case_date",
            "patient_event_onset_date",
            "patient_date_of_death",
            "patient_birth_date",
        )
        if c in kept.columns
    ]
    one = dedupe_by_priority(
        parse_ints(parse_dates(kept, dates), ["patient_age_at_event_in_years"]),
        "patient_record_number",
        "person_facility_visit_type",
        VISIT_ORDER,
        tiebreak,
    ).drop(INPUT_ORDER)
    return one.withColumns(
        {
            "week_of": week_floor("covid_case_date"),
            "epi_week": epi_week("covid_case_date"),
            "epi_year": epi_year("covid_case_date"),
            "agecat": age_band("patient_age_at_event_in_years"),
            "city": normalize_text("address_at_diagnosis_city", city_rules()),
            "hospitalized": flag_any(
                F.col("corona_pui_col_hosp_ncov") == "Yes",
                F.col("corona_pui_col_icu") == "Yes",
                F.col("person_facility_visit_type") == "Inpatient",
            ),
        }
    )


LAB_COLUMNS = ("patient_record_number", "first_positive_lab", "case_onset_date")


def link_collection_date(cases: DataFrame, investigations: DataFrame) -> DataFrame:
    """Full linkage on the record number, adding the test collection date of the case extract."""
    lab = parse_dates(
        cases.select(*LAB_COLUMNS),
        ["first_positive_lab", "case_onset_date"],
    )
    return link_records(lab, investigations, "patient_record_number", right_unique=True)
