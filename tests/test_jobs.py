"""The two batch runs over hand-made extracts, with the edge rows that matter."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewatch import plans as P
from tidewatch.operators import dropped_events
from tidewatch.plans.batches import PUBLISHED_ORDER
from tidewatch.plans.charts import chart_captions
from tidewatch.session import stage
from tidewatch.sources import (
    read_published,
    snapshot_dates,
    commit_snapshot,
    dense_grid,
    dimension,
    publish,
    read_extract,
    read_snapshot,
    write_extract,
)

D = dt.date
HOME = "Home"
AS_OF = D(2021, 9, 20)
YEAR_START = D(2021, 8, 18)
RNG = random.Random(11)

CASE_SCHEMA = (
    "patient_record_number string, case_date string, case_onset_date string, hosp_admit_date string, "
    "first_positive_lab string, county int, lhd int, st_case_status string, breakthrough string, "
    "reinfection string, hosp string, age string, condition_caused_death string, covid_death string"
)
INVESTIGATION_SCHEMA = (
    "patient_record_number string, covid_case_date string, patient_event_onset_date string, "
    "patient_birth_date string, patient_age_at_event_in_years int, "
    "patient_jurisdiction_of_residence string, patient_jurisdiction_of_investigation string, "
    "patient_state_case_status string, condition_caused_death string, "
    "person_facility_visit_type string, corona_pui_col_hosp_ncov string, corona_pui_col_icu string, "
    "address_at_diagnosis_city string, address_at_diagnosis_county string, "
    "corona_pui_col_school_univ string, corona_pui_col_school_univ_type string, "
    "corona_pui_col_school_univ_type_details string, corona_pui_col_school_acquired_case string, "
    "exposure_place_school_district string, place_name string, person_first_name string, "
    "person_last_name string, corona_pui_col_covid_sympt string, "
    "corona_pui_col_school_univ_event string, corona_pui_col_school_univ_event_details string, "
    "corona_pui_col_school_univ_activity string, corona_pui_col_school_univ_activities_details string, "
    "corona_pui_col_school_univ_bus_details string, covid_interview_complete string"
)


def day(offset: int) -> D:
    return YEAR_START + dt.timedelta(days=offset)


def make_cases() -> list[dict]:
    out = []
    for i in range(300):
        when = None if i == 0 else D(2020, 2, 25) + dt.timedelta(days=RNG.randrange(590))
        hosp = RNG.random() < 0.3
        out.append(
            {
                "patient_record_number": f"r{i}",
                "case_date": when and f"{when} 08:00:00",
                "case_onset_date": None,
                "hosp_admit_date": str(when) if when and hosp else None,
                "first_positive_lab": str(when) if when else "",
                "county": RNG.choice([2, 3, 3, 17, 99, None]),
                "lhd": RNG.choice([0, 1, 1]),
                "st_case_status": RNG.choice(["Confirmed", "Confirmed", "Probable"]),
                "breakthrough": RNG.choice(["Yes", "No", "", None]),
                "reinfection": RNG.choice(["Yes", "No", None]),
                "hosp": "Yes" if hosp else "No",
                "age": RNG.choice(["0-1", "1-14", "15-24", "85+", None]),
                "condition_caused_death": "No",
                "covid_death": "No",
            }
        )
    return out


PLACES = (
    ("Box Elder District", "Box Elder High - Box Elder District"),
    ("Cache District", "Sky View High - Cache District"),
    ("Cache District", "A school nobody listed"),
    ("Logan City District", "Logan High - Logan City District"),
    ("Rich District", "Rich High - Rich District"),
    ("Thomas Edison", "Thomas Edison"),
    ("Thomas Edison Charter School South", "Thomas Edison Charter School South"),
    ("Fast Forward High", "Fast Forward High"),
    ("Elsewhere District", "Elsewhere High"),
    ("Cache District", ""),
)


def make_investigations() -> list[dict]:
    out = []
    for i in range(400):
        place = PLACES[i % len(PLACES)]
        when = day(RNG.randrange(-6, 34))
        onset = None if i % 13 == 0 else when - dt.timedelta(days=RNG.randrange(0, 6))
        out.append(
            {
                "patient_record_number": f"r{i // 2 if i % 9 == 0 else i}",
                "covid_case_date": str(when),
                "patient_event_onset_date": str(onset) if onset else "",
                "patient_birth_date": "2010-05-01 00:00:00" if i % 3 else "1990-05-01 00:00:00",
                "patient_age_at_event_in_years": RNG.choice([4, 5, 11, 17, 18, 19, None]),
                "patient_jurisdiction_of_residence": RNG.choice([HOME, HOME, "", None, "Away"]),
                "patient_jurisdiction_of_investigation": RNG.choice([HOME, "Utah State"]),
                "patient_state_case_status": RNG.choice(["Confirmed", "Confirmed", "Probable"]),
                "condition_caused_death": RNG.choice(["No", "No", "Yes"]),
                "person_facility_visit_type": RNG.choice(
                    ["Inpatient", "Outpatient", "Unknown", "", None]
                ),
                "corona_pui_col_hosp_ncov": RNG.choice(["Yes", "No", None]),
                "corona_pui_col_icu": None,
                "address_at_diagnosis_city": RNG.choice(
                    ["NORTH LOGAN", "logan", "Logan", "Brigham", "Nowhere", None]
                ),
                "address_at_diagnosis_county": RNG.choice(["BE", "CA", "RI"]),
                "corona_pui_col_school_univ": RNG.choice(["Yes", "No"]),
                "corona_pui_col_school_univ_type": RNG.choice(
                    ["Student", "Student", "Teacher", "Volunteer/visitor", "volunteer-visitor"]
                ),
                "corona_pui_col_school_univ_type_details": "",
                "corona_pui_col_school_acquired_case": RNG.choice(["Yes", "No"]),
                "exposure_place_school_district": place[0],
                "place_name": place[1],
                "person_first_name": f"F{i}",
                "person_last_name": f"L{i}",
                "corona_pui_col_covid_sympt": RNG.choice(["Yes", "No", "", None]),
                "corona_pui_col_school_univ_event": "",
                "corona_pui_col_school_univ_event_details": "",
                "corona_pui_col_school_univ_activity": "",
                "corona_pui_col_school_univ_activities_details": "",
                "corona_pui_col_school_univ_bus_details": "",
                "covid_interview_complete": RNG.choice(["f", "t"]),
            }
        )
    return out


CASES, INVESTIGATIONS = make_cases(), make_investigations()


@pytest.fixture(scope="module")
def inputs(spark):
    deaths = [
        ("2020-04-04 00:00:00", "2020-03-20", "Yes", "Yes", "85+", 2, 1),
        ("2020-04-05", "2020-03-31", "Yes", "No", "85+", 3, 1),
        ("2020-04-11", "2020-06-01", "No", "No", "65-84", 17, 0),
        ("", "2020-06-02", "Yes", None, None, 3, 1),
        ("2020-03-01", "2020-02-20", "Yes", "Yes", "<1", None, 0),
    ]
    tests = [
        ("2020-03-01", "2020-03-02", "POSITIVE", "PCR/amplification", HOME, "Cache"),
        ("2020-03-01", "2020-03-02", "NEGATIVE", "PCR/amplification", HOME, "Cache"),
        ("2020-03-01", "2020-03-02", "POSITIVE", "Antigen", HOME, "Cache"),
        ("2020-03-02", "2020-03-03", "POSITIVE", "PCR/amplification", "Away", "Weber"),
        ("2020-03-03", "2020-03-03", "UNCLEAR", "PCR/amplification", HOME, "Rich"),
    ]
    doses = [
        ("2020-12-17", 84322, "Hispanic or Latino", "White", HOME, "Cache", 1, None, None, 30, "30-39"),
        ("2020-12-18", 84321, "No", "White", HOME, "Cache", 2, "Complete", None, 30, "30-39"),
        ("2020-12-18", 84321, None, "Asian", HOME, "Rich", 1, "Complete", None, 5, "5-11"),
        ("2020-12-20", 84321, "No", "Unknown", "Away", "Cache", 3, None, "Yes", 12, "12-18"),
        ("2020-12-20", 84321, "No", "White", HOME, "Box Elder", 1, None, None, None, "Unknown"),
        ("2020-12-01", 84321, "No", "White", HOME, "Box Elder", 1, None, None, 70, "70-79"),
    ]
    test_schema = (
        "collect_date_fillrph string, case_date string, test_result string, test_type string, "
        "lhd string, county string"
    )
    return {
        "cases": spark.createDataFrame(
            [tuple(c.values()) for c in CASES], CASE_SCHEMA
        ),
        "deaths": spark.createDataFrame(
            deaths,
            "date_of_death string, case_date string, patient_died string, breakthrough string, "
            "age string, county int, lhd int",
        ),
        "tests": spark.createDataFrame(tests, test_schema),
        "daytests": spark.createDataFrame(tests, test_schema),
        "doses": spark.createDataFrame(
            doses,
            "vaccine_date string, zipcode int, ethnicity string, race string, district string, "
            "county string, dose_all int, vaccine_status string, booster_dose string, "
            "age_original int, age string",
        ),
        "investigations": spark.createDataFrame(
            [tuple(c.values()) for c in INVESTIGATIONS], INVESTIGATION_SCHEMA
        ),
    }


@pytest.fixture(scope="module")
def nightly(inputs):
    return P.nightly_tables(inputs, AS_OF, HOME)


@pytest.fixture(scope="module")
def linked(inputs):
    return P.link_collection_date(
        inputs["cases"], P.clean_investigations(inputs["investigations"], HOME)
    ).cache()


@pytest.fixture(scope="module")
def school(inputs):
    return P.school_tables(inputs["investigations"], inputs["cases"], AS_OF, HOME)


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


# ---------------------------------------------------------------- nightly batch


def test_deaths_weekly(nightly):
    got = by(nightly["deaths_weekly"], "week_of", "region")
    assert len(got) == 4 * 78
    first, second = D(2020, 3, 29), D(2020, 4, 5)
    assert got[first, "District"].weekly_deaths == 1
    assert got[second, "District"].weekly_deaths == 1
    assert got[second, "District"].total_deaths == 2
    assert got[second, "Rich"].weekly_deaths == 1
    assert got[second, "District"].unvaccinated == 2
    assert got[second, "District"].age_65_84 == 1
    assert got[D(2020, 4, 12), "District"].deaths_4wa is None
    assert got[D(2020, 4, 19), "District"].deaths_4wa == 0.5


def test_deaths_monthly_buckets_by_case_date(nightly):
    got = {r.month: r for r in nightly["deaths_monthly"].collect()}
    assert sorted(got) == [D(2020, m, 1) for m in (2, 3, 4, 5, 6)]
    assert (got[D(2020, 3, 1)].monthly_deaths, got[D(2020, 3, 1)].vac_perc) == (2, 0.5)
    assert (got[D(2020, 5, 1)].monthly_deaths, got[D(2020, 5, 1)].vac_perc) == (0, None)


def parsed(case):
    return case["case_date"] and D.fromisoformat(case["case_date"][:10])


def test_cases_daily_against_brute_force(nightly):
    got = by(nightly["cases_daily"], "date", "region")
    start = D(2020, 3, 1)
    days = [start + dt.timedelta(days=i) for i in range((AS_OF - start).days + 1)]
    assert len(got) == 4 * len(days)
    codes = {"Box Elder": 2, "Cache": 3, "Rich": 17}
    sizes = {"District": 189463, "Box Elder": 57007, "Cache": 130004, "Rich": 2452}
    for region, size in sizes.items():
        total, seen = 0, []
        for d in days:
            mine = [c for c in CASES if parsed(c) == d]
            if region == "District":
                n = sum(c["st_case_status"] == "Confirmed" for c in mine)
            else:
                n = sum(c["county"] == codes[region] for c in mine)
            total += n
            seen.append(n)
            r = got[d, region]
            assert (r.new_cases, r.total_cases) == (n, total)
            if len(seen) < 7:
                assert r.mean_7d is None and r.sum_7d is None and r.rate_7d is None
            else:
                s = sum(seen[-7:])
                assert r.sum_7d == s
                assert r.mean_7d == pytest.approx(s / 7, abs=0.0501)
                assert r.rate_7d == pytest.approx(s * 1000 / size, abs=0.00501)
            if n == 0:
                assert r.vac_perc is None


def test_weekly_cases_leave_out_the_current_week(nightly):
    weeks = [r.week_of for r in nightly["cases_weekly"].select("week_of").distinct().collect()]
    assert max(weeks) == D(2021, 9, 12)
    hospital = nightly["hospital_weekly"].agg(F.max("week_of"), F.min("week_of")).first()
    assert tuple(hospital) == (D(2021, 9, 19), D(2020, 3, 15))


def test_positivity(nightly):
    got = by(nightly["positivity_person"], "date", "region")
    assert got[D(2020, 3, 1), "District"].positivity == 0.5
    # A positive test outside the district on a day without district tests: undefined, so 0.
    outside = got[D(2020, 3, 2), "District"]
    assert (outside.tests, outside.positives, outside.positivity) == (0, 1, 0.0)
    assert got[D(2020, 3, 6), "District"].positivity_7d is None
    assert got[D(2020, 3, 7), "District"].positivity_7d == 7.1
    by_test = by(nightly["positivity_test"], "date", "region")
    assert by_test[D(2020, 3, 2), "Cache"].tests == 2


def test_coverage(nightly):
    got = by(nightly["coverage"], "date", "region", "dose", "band")
    d = D(2020, 12, 20)
    assert got[d, "District", "first", "all"].total == 3
    assert got[d, "District", "first", "hisp"].total == 1
    assert got[d, "District", "second", "5up"].total == 2
    assert got[d, "Cache", "third", "12up"].total == 1
    assert got[d, "District", "third", "12up"].total == 0
    assert got[d, "District", "first", "unknown_age"].total == 1
    assert got[d, "District", "first", "unknown_age"].percent is None
    assert got[d, "Rich", "first", "5up"].percent == round(100 / 2284, 2)
    assert got[d, "District", "total", "all"].total == 4
    assert (d, "District", "third", "5up") not in got
    assert got[D(2020, 12, 16 + 1), "District", "total", "all"].total == 1


def test_city_counts_use_the_normalised_name(inputs, nightly):
    clean = P.clean_investigations(inputs["investigations"], HOME)
    want = {
        (r.d, r.city): r.n
        for r in clean.groupBy(F.col("covid_case_date").alias("d"), "city")
        .agg(F.count("*").alias("n"))
        .collect()
    }
    got = by(nightly["city_daily"], "date", "city")
    assert any(r.cases for r in got.values())
    assert all(r.cases == want.get((d, c), 0) for (d, c), r in got.items())
    assert len({c for _, c in got}) == 18
    assert max(d for d, _ in got) == max(d for d, _ in want)


def test_scorecards_in_both_languages(nightly):
    card = {r.region: r for r in nightly["scorecard"].collect()}
    assert {k: v.position for k, v in card.items()} == {
        "Box Elder": 1, "Cache": 2, "Rich": 3, "District": 4,
    }
    assert card["District"].total_cases == sum(c["lhd"] == 1 for c in CASES)
    assert card["Rich"].total_hospitalizations == sum(
        c["county"] == 17 and c["hosp"] == "Yes" for c in CASES
    )
    assert card["District"].total_deaths == 3
    spanish = P.labelled(nightly["scorecard"], "es")
    assert "Muertes Totales" in spanish.columns and "Región" in spanish.columns
    doses = {r.region: r for r in nightly["dose_scorecard"].collect()}
    assert doses["District"].total_doses == 4
    assert doses["Cache"].percent_first_5up == 0


def test_charts(nightly):
    for lang in ("en", "es"):
        charts = P.chart_tables(nightly, AS_OF, lang)
        assert len(charts) == len(P.CHARTS) == 23
        assert set(chart_captions(lang)) == set(charts)
        for table in charts.values():
            assert table.columns == ["x", "series", "value", "provisional"]
    weekly = P.chart_tables(nightly, AS_OF, "es")["weekly_deaths"]
    assert {r.series for r in weekly.select("series").distinct().collect()} == {
        "Muertes semanales", "Promedio de 4 semanas",
    }
    assert weekly.filter("provisional").select("x").distinct().count() == 2
    rates = P.chart_tables(nightly, AS_OF, "en")["cases_rate"]
    assert {r.series for r in rates.select("series").distinct().collect()} == {
        f"{r} 7-Day Rate" for r in ("District", "Box Elder", "Cache", "Rich")
    }


# ---------------------------------------------------------------- school batch


def cleaned_by_hand():
    rank = {"Inpatient": 0, "Outpatient": 1, "Unknown": 2}
    kept = [
        c
        for c in INVESTIGATIONS
        if (c["patient_jurisdiction_of_residence"] or "") in (HOME, "")
        and (
            c["patient_state_case_status"] == "Confirmed" or c["condition_caused_death"] == "Yes"
        )
    ]
    best = {}
    for c in kept:
        key = c["patient_record_number"]
        place = rank.get(c["person_facility_visit_type"], 3)
        best.setdefault(key, set()).add(place)
    return kept, {k: min(v) for k, v in best.items()}


def test_clean_investigations(inputs):
    kept, best = cleaned_by_hand()
    rank = {"Inpatient": 0, "Outpatient": 1, "Unknown": 2}
    got = P.clean_investigations(inputs["investigations"], HOME).collect()
    assert len(got) == len({c["patient_record_number"] for c in kept})
    for r in got:
        assert rank.get(r.person_facility_visit_type, 3) == best[r.patient_record_number]
        assert r.week_of.isoweekday() == 7
        if r.person_facility_visit_type == "Inpatient" or r.corona_pui_col_hosp_ncov == "Yes":
            assert r.hospitalized == 1


def test_linkage_keeps_both_sides(inputs, linked):
    ids = {r.patient_record_number for r in linked.collect()}
    _, best = cleaned_by_hand()
    assert ids == {c["patient_record_number"] for c in CASES} | set(best)


@pytest.fixture(scope="module")
def cohort_rows(linked):
    return P.k12_cohort(linked).collect()


def test_cohort(cohort_rows):
    assert cohort_rows
    for r in cohort_rows:
        assert r.covid_case_date >= YEAR_START
        assert r.corona_pui_col_school_univ_type in ("Student", "Teacher")
        assert r.exposure_place_school_district != "Elsewhere District"
    names = {(r.place_name, r.school, r.district) for r in cohort_rows}
    assert ("Thomas Edison", "Thomas Edison North", "Charter/Other Schools") in names
    assert any(s == "Thomas Edison South" for _, s, _ in names)
    assert any(p == s == "A school nobody listed" for p, s, _ in names)


def open_by_hand(starts, d, k):
    return sum(YEAR_START <= s <= d and s + dt.timedelta(days=k) > d for s in starts if s)


def test_school_panel_against_brute_force(school, cohort_rows):
    got = by(school["school_panel"], "date", "school")
    assert len(got) == 67 * ((AS_OF - YEAR_START).days + 1)
    assert len(school["school_panel"].columns) == 21
    for (d, name), r in got.items():
        mine = [c for c in cohort_rows if c.school == name]
        students = [
            c.covid_case_date for c in mine
            if c.patient_age_at_event_in_years is not None
            and 5 <= c.patient_age_at_event_in_years <= 18
        ]
        onsets = [c.patient_event_onset_date for c in mine]
        acquired = [
            c.patient_event_onset_date for c in mine
            if c.corona_pui_col_school_acquired_case == "Yes"
        ]
        assert r.new_student_cases == students.count(d)
        assert r.current_threshold_cases == open_by_hand(students, d, 7)
        assert r.active_cases == open_by_hand(onsets, d, 10)
        assert r.active_school_transmitted == open_by_hand(acquired, d, 10)
        if r.enrollment is None:
            assert r.percent_of_enrollment is None and r.incidence_per_1000 is None
        else:
            share = 100 * r.current_threshold_cases / r.enrollment
            assert r.percent_of_enrollment == pytest.approx(share, abs=0.00501)
        if d < day(4):
            assert r.five_day_average is None


def test_district_panel_and_summary(school, cohort_rows):
    got = by(school["district_panel"], "date", "school")
    assert len(school["district_panel"].columns) == 16
    for (d, name), r in got.items():
        students = [
            c.covid_case_date for c in cohort_rows
            if c.district == name and c.corona_pui_col_school_univ_type == "Student"
        ]
        assert r.current_threshold_cases == open_by_hand(students, d, 7) >= 0
    # The charter district is counted like any other.
    assert got[AS_OF, "Charter/Other Schools"].total_student_cases > 0
    summary = school["latest_summary"].collect()
    assert len(summary) == 67 + 5
    assert sum(r.is_total for r in summary) == 5
    assert school["drilldown"].filter(F.col("school") == "Rich High School").count() == 34


def test_literal_district_panel_mixes_the_student_rules(linked):
    cohort = P.k12_cohort(linked)
    literal = P.district_panel(cohort, AS_OF, literal=True)
    got = by(literal, "date", "school")
    data = cohort.collect()
    for (d, name), r in got.items():
        mine = [c for c in data if c.district == name]
        entered = sum(
            c.corona_pui_col_school_univ_type == "Student" and c.covid_case_date <= d for c in mine
        )
        left = sum(
            c.patient_age_at_event_in_years is not None
            and 5 <= c.patient_age_at_event_in_years <= 18
            and c.covid_case_date + dt.timedelta(days=7) <= d
            for c in mine
        )
        assert r.current_threshold_cases == entered - left


def test_schools_off_the_grid_are_audited(spark, linked):
    cohort = P.k12_cohort(linked).withColumn("date", F.col("covid_case_date"))
    grid = dense_grid(dimension(spark, "school").select("school"), YEAR_START, AS_OF)
    lost = dropped_events(cohort, grid, ["date", "school"])
    assert "A school nobody listed" in {r.school for r in lost.collect()}


def test_line_list_and_notices(spark, inputs, linked, cohort_rows):
    cohort = P.k12_cohort(linked)
    sent = P.line_list(cohort, AS_OF).collect()
    recent = [c for c in cohort_rows if c.covid_case_date >= AS_OF - dt.timedelta(days=13)]
    names = {r.recipient for r in sent}
    assert {"cache_county", "box_elder", "logan_city", "rich_high", "fast_forward"} <= names
    # A listed district gets every school of it, the unknown ones too.
    cache = [c for c in recent if c.district == "Cache County School District"]
    assert sum(r.recipient == "cache_county" for r in sent) == len(cache)
    for r in sent:
        assert r.symptoms in ("Yes", "No", "Unknown")
        if r.onset_date:
            assert r.isolate_through == r.onset_date + dt.timedelta(days=10)
            assert r.infectious_start_date == r.onset_date - dt.timedelta(days=2)
        if r.recipient == "thomas_edison_south":
            assert r.school == "Thomas Edison South"
        if r.recipient == "rich_high":
            assert r.school == "Rich High - Rich District"
    previous = cohort.filter(F.col("covid_case_date") < D(2021, 9, 10))
    tables = P.school_tables(
        inputs["investigations"], inputs["cases"], AS_OF, HOME, previous_cohort=previous
    )
    new = {c.patient_record_number for c in cohort_rows if c.covid_case_date >= D(2021, 9, 10)}
    assert {r.patient_record_number for r in tables["new_cases"].collect()} == new
    notices = tables["notices"].collect()
    assert notices
    for r in notices:
        if r.test_collection_date:
            assert r.isolate_through == r.test_collection_date + dt.timedelta(days=5)
            assert r.can_return_on == r.test_collection_date + dt.timedelta(days=6)


def test_follow_up_lists(linked, school):
    rows = linked.collect()

    def minor(c):
        age = c.patient_age_at_event_in_years
        return age is not None and 5 <= age <= 17 and c.place_name == ""

    want = set()
    for c in rows:
        if not minor(c):
            continue
        county, city, d = c.address_at_diagnosis_county, c.address_at_diagnosis_city, c.covid_case_date
        if county == "BE" and d >= D(2021, 8, 30):
            want.add(("box_elder", c.patient_record_number))
        elif county == "RI" and d >= D(2021, 8, 30):
            want.add(("rich", c.patient_record_number))
        elif county == "CA" and d >= YEAR_START:
            want.add(("logan" if city == "Logan" else "cache", c.patient_record_number))
    got = {(r.area, r.patient_record_number) for r in school["minors"].collect()}
    assert got == want and want
    for r in school["missing_school"].collect():
        assert not r.place_name and r.corona_pui_col_school_univ == "Yes"
    early = P.adults_to_reroute(linked, since=YEAR_START).collect()
    assert {r.patient_record_number for r in early} == {
        c.patient_record_number
        for c in rows
        if c.patient_jurisdiction_of_investigation == "Utah State"
        and c.covid_interview_complete == "f"
        and c.corona_pui_col_school_univ == "Yes"
        and c.patient_birth_date <= D(2003, 11, 2)
        and c.covid_case_date >= YEAR_START
        and c.corona_pui_col_school_univ_type in ("Student", "Teacher")
        and c.exposure_place_school_district
        not in ("Elsewhere District", "Thomas Edison Charter School South")
    }


def test_single_school_slice(linked, cohort_rows):
    cohort = P.k12_cohort(linked)
    name = "Sky View High - Cache District"
    got = P.school_slice(cohort, [name], AS_OF, days=7).collect()
    assert len(got) == sum(
        c.place_name == name and c.covid_case_date >= AS_OF - dt.timedelta(days=7)
        for c in cohort_rows
    )
    assert P.school_slice(cohort, [name]).count() == sum(c.place_name == name for c in cohort_rows)


def test_hospital_delta_and_snapshots(spark, inputs, tmp_path):
    cases = P.clean_case_extract(inputs["cases"])
    hospital = cases.filter(F.col("hosp") == "Yes")
    path = str(tmp_path / "hospital")
    commit_snapshot(hospital.filter(F.col("case_date") < "2021-06-01"), path, "2021-09-19")
    tables = P.nightly_tables(
        inputs, AS_OF, HOME, previous_hospital=read_snapshot(spark, path, AS_OF)
    )
    got = {r.patient_record_number for r in tables["hospital_delta"].collect()}
    # Identical rows merge into one and stay, as do new ones.
    assert got == {c["patient_record_number"] for c in CASES if c["hosp"] == "Yes"}


def test_nightly_batch_from_text_extracts(spark, inputs, nightly, rows, tmp_path):
    """The same tables come out when every extract is read from CSV as text."""
    read = {}
    for name, df in inputs.items():
        write_extract(df, str(tmp_path / name))
        read[name] = read_extract(spark, str(tmp_path / name))
        assert set(read[name].dtypes) == {(c, "string") for c in read[name].columns}
    again = P.nightly_tables(read, AS_OF, HOME)
    for name in ("cases_weekly", "deaths_monthly", "coverage", "scorecard", "dose_scorecard"):
        assert rows(again[name]) == rows(nightly[name])


def test_staging_does_not_change_the_tables(inputs, school, rows, tmp_path):
    staged = P.school_tables(
        inputs["investigations"],
        inputs["cases"],
        AS_OF,
        HOME,
        stage=lambda df: stage(df, str(tmp_path)),
    )
    for name in ("latest_summary", "minors", "line_list"):
        assert rows(staged[name]) == rows(school[name])


def test_publish_the_summary(spark, school, tmp_path):
    base = str(tmp_path)
    publish({"latest_summary": school["latest_summary"]}, base, AS_OF)
    assert spark.read.parquet(f"{base}/en/latest/latest_summary").count() == 72


def test_every_published_table_has_an_order(nightly, school):
    tables = {**nightly, **school}
    assert not set(tables) - set(PUBLISHED_ORDER)
    for name, df in tables.items():
        assert not set(PUBLISHED_ORDER[name]) - set(df.columns), name


def test_both_batches_run_twice(spark, inputs, rows, tmp_path):
    """From extracts to published bundles, recipients' files and snapshots; the second day has no news."""
    base, snapshots = str(tmp_path / "out"), str(tmp_path / "snapshots")
    days = (AS_OF - dt.timedelta(days=1), AS_OF)
    for day in days:
        P.run_nightly(inputs, day, HOME, base, snapshots)
        P.run_schools(inputs["investigations"], inputs["cases"], day, HOME, base, snapshots)
    for name, order in PUBLISHED_ORDER.items():
        df = read_published(spark, base, name)
        assert not set(order) - set(df.columns), name
    assert read_published(spark, base, "new_cases").count() == 0
    assert read_published(spark, base, "cohort").count() > 0
    for name in ("hospital", "cohort", "minors"):
        assert snapshot_dates(spark, f"{snapshots}/{name}") == list(days)
