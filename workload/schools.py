"""School-year cohort, panels and line lists over the derived linked cases."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidewatch import plans as P
from tidewatch.operators import new_records
from tidewatch.operators import symmetric_delta as delta_of
from tidewatch.plans.lists import LIST_DAYS, SLICE
from tidewatch.plans.schools import DRILLDOWN, SUMMARY

from .derived import AS_OF, SNAPSHOT_CUTOFF, START, extract, extract_sql, table
from .registry import full_window, half_even, half_even_units, query, running, spine_sql

START_DAY = dt.date.fromisoformat(START)
FOLLOWUP = dt.date(1996, 8, 30)
LINKED_SQL = extract_sql("linked")

# ---------------------------------------------------------------- dimensions from the tables

_PLACES = "nation JOIN region ON n_regionkey = r_regionkey"
DISTRICTS_SQL = (
    "SELECT concat(r_name, ' District') AS exposure_district, concat(r_name, ' Schools') AS "
    "district FROM region WHERE r_name <> 'EUROPE'"
)
ALIASES_SQL = f"SELECT concat(n_name, ' School') AS place_name, n_name AS school FROM {_PLACES}"
SCHOOLS_SQL = (
    "SELECT n_name AS school, CASE WHEN n_name = 'NATION_7' THEN NULL ELSE count(*) END AS "
    "enrollment, concat(r_name, ' Schools') AS district FROM customer "
    "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey "
    "WHERE r_name <> 'EUROPE' GROUP BY n_name, r_name"
)
DISTRICT_SIZES_SQL = (
    "SELECT concat(r_name, ' Schools') AS district, CASE WHEN r_name = 'ASIA' THEN NULL "
    "ELSE count(*) END AS enrollment FROM customer JOIN nation ON c_nationkey = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'EUROPE' GROUP BY r_name"
)
RECIPIENTS_SQL = (
    "SELECT lower(r_name) AS recipient, 'district' AS kind, concat(r_name, ' Schools') AS value "
    "FROM region WHERE r_name IN ('ASIA', 'AFRICA') UNION ALL "
    f"SELECT lower(n_name), 'school', n_name FROM {_PLACES} WHERE r_name IN ('AMERICA', 'ASIA')"
)


def _places(spark, sf_dir):
    return table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey")
    )


def exposure_districts(spark, sf_dir):
    return (
        table(spark, sf_dir, "region")
        .filter("r_name <> 'EUROPE'")
        .selectExpr(
            "concat(r_name, ' District') AS exposure_district",
            "concat(r_name, ' Schools') AS district",
        )
    )


def aliases(spark, sf_dir):
    return _places(spark, sf_dir).selectExpr(
        "concat(n_name, ' School') AS place_name", "n_name AS school"
    )


def _enrolled(spark, sf_dir):
    return (
        table(spark, sf_dir, "customer")
        .join(_places(spark, sf_dir), F.expr("c_nationkey = n_nationkey"))
        .filter("r_name <> 'EUROPE'")
    )


def school_sizes(spark, sf_dir):
    return (
        _enrolled(spark, sf_dir)
        .groupBy("n_name", "r_name")
        .agg(F.count("*").alias("n"))
        .selectExpr(
            "n_name AS school",
            "CASE WHEN n_name = 'NATION_7' THEN NULL ELSE n END AS enrollment",
            "concat(r_name, ' Schools') AS district",
        )
    )


def district_sizes(spark, sf_dir):
    return (
        _enrolled(spark, sf_dir)
        .groupBy("r_name")
        .agg(F.count("*").alias("n"))
        .selectExpr(
            "concat(r_name, ' Schools') AS district",
            "CASE WHEN r_name = 'ASIA' THEN NULL ELSE n END AS enrollment",
        )
    )


def recipients(spark, sf_dir):
    by_district = (
        table(spark, sf_dir, "region")
        .filter("r_name IN ('ASIA', 'AFRICA')")
        .selectExpr(
            "lower(r_name) AS recipient",
            "'district' AS kind",
            "concat(r_name, ' Schools') AS value",
        )
    )
    by_school = (
        _places(spark, sf_dir)
        .filter("r_name IN ('AMERICA', 'ASIA')")
        .selectExpr("lower(n_name) AS recipient", "'school' AS kind", "n_name AS value")
    )
    return by_district.unionByName(by_school)


# ---------------------------------------------------------------- cohort


def linked(spark, sf_dir):
    return extract(spark, sf_dir, "linked")


def cohort(spark, sf_dir):
    return P.k12_cohort(
        linked(spark, sf_dir),
        START_DAY,
        exposure_districts(spark, sf_dir),
        aliases(spark, sf_dir),
    )


COHORT_SQL = (
    f"SELECT l.*, d.district, coalesce(a.school, l.place_name) AS school FROM ({LINKED_SQL}) l "
    f"JOIN ({DISTRICTS_SQL}) d ON l.exposure_place_school_district = d.exposure_district "
    f"LEFT JOIN ({ALIASES_SQL}) a ON l.place_name = a.place_name "
    f"WHERE covid_case_date >= DATE '{START}' AND corona_pui_col_school_univ_type NOT IN "
    "('Volunteer/visitor', 'volunteer-visitor')"
)


@query(COHORT_SQL)
def k12_cohort(spark, sf_dir):
    return cohort(spark, sf_dir)


# ---------------------------------------------------------------- panels

_AGE_STUDENT = "patient_age_at_event_in_years BETWEEN 5 AND 18"
_TYPE_STUDENT = "corona_pui_col_school_univ_type = 'Student'"
_ACQUIRED = "corona_pui_col_school_acquired_case = 'Yes'"


def entity_panel_sql(
    entity: str,
    dim: str,
    start: str,
    literal: bool,
    student_in: str,
    student_out: str,
) -> str:
    """CTEs ending in ``b``: entries, running totals, exits and open numbers per day."""

    def daily(name: str, at: str, where: str) -> str:
        return (
            f"{name} AS (SELECT {entity}, {at} AS d, count(*) AS n FROM x WHERE {where} "
            "GROUP BY 1, 2)"
        )

    def later(col: str, k: int) -> str:
        return f"CAST({col} + INTERVAL {k} DAY AS DATE)"

    case, onset = "covid_case_date", "patient_event_onset_date"
    legs = {
        "s_in": (case, student_in),
        "s_out": (later(case, 7), student_out),
        "n_in": (onset, "TRUE"),
        "n_out": (later(onset, 10), "TRUE"),
        "t_in": (onset, _ACQUIRED),
        "t_out": (later(onset, 10), _ACQUIRED),
    }
    ctes = ", ".join(daily(n, at, where) for n, (at, where) in legs.items())
    joins = " ".join(
        f"LEFT JOIN {n} ON {n}.{entity} = g.{entity} AND {n}.d = g.date" for n in legs
    )
    cols = ", ".join(f"CAST(coalesce({n}.n, 0) AS BIGINT) AS c_{n}" for n in legs)
    totals = ", ".join(f"{running(f'c_{n}', 'date', entity)} AS r_{n}" for n in legs)

    def gone(leg: str, k: int) -> str:
        if literal:
            return f"r_{leg}_out"
        return (
            f"CAST(coalesce(lag(r_{leg}_in, {k}) OVER (PARTITION BY {entity} ORDER BY date), 0) "
            "AS BIGINT)"
        )

    return f"""WITH x AS ({COHORT_SQL}), dim AS ({dim}), {ctes},
    g AS (SELECT dim.*, s.date FROM dim, ({spine_sql(start, AS_OF)}) s),
    p AS (SELECT g.*, {cols} FROM g {joins}),
    r AS (SELECT *, {totals} FROM p),
    e AS (SELECT *, {gone('s', 7)} AS e_s, {gone('n', 10)} AS e_n, {gone('t', 10)} AS e_t FROM r),
    b AS (SELECT *, e_s AS students_after_7, r_s_in - e_s AS current_threshold_cases,
    e_n AS recovered, r_n_in - e_n AS active_cases, e_t AS st_recovered,
    r_t_in - e_t AS active_school_transmitted,
    {half_even('(r_s_in - e_s) * 100', 'enrollment', 2)} AS percent_of_enrollment FROM e)"""


def school_panel_sql(start: str, literal: bool) -> str:
    head = entity_panel_sql("school", SCHOOLS_SQL, start, literal, _AGE_STUDENT, _AGE_STUDENT)
    mean = half_even_units("s5", "5", 1)
    return f"""{head}, f AS (SELECT *, {full_window('sum', 'c_n_in', 5, 'date', 'school')} AS s5
    FROM b), h AS (SELECT *, {mean} AS mean10 FROM f),
    i AS (SELECT *, {half_even_units('mean10 * 1000', 'enrollment * 10', 2)} AS inc FROM h),
    j AS (SELECT *, lag(inc, 5) OVER (PARTITION BY school ORDER BY date) AS inc5 FROM i),
    panel AS (SELECT date, school, enrollment, district, c_s_in AS new_student_cases,
    r_s_in AS total_student_cases, students_after_7, current_threshold_cases,
    percent_of_enrollment, c_n_in AS new_cases, r_n_in AS total_cases, recovered, active_cases,
    CAST(mean10 AS DOUBLE) / 10 AS five_day_average, CAST(inc AS DOUBLE) / 100 AS
    incidence_per_1000, {half_even('inc', 'inc5', 2)} AS ratio,
    1 - {half_even('inc', 'inc5', 2)} AS five_day_decrease, c_t_in AS new_school_transmission,
    r_t_in AS total_school_transmitted, st_recovered, active_school_transmitted FROM j)"""


def district_panel_sql(start: str, literal: bool) -> str:
    out = _AGE_STUDENT if literal else _TYPE_STUDENT
    head = entity_panel_sql("district", DISTRICT_SIZES_SQL, start, literal, _TYPE_STUDENT, out)
    return f"""{head}, panel AS (SELECT date, c_s_in AS new_student_cases,
    r_s_in AS total_student_cases, district AS school, enrollment, c_n_in AS new_cases,
    r_n_in AS total_cases, c_t_in AS new_school_transmission, r_t_in AS total_school_transmitted,
    students_after_7, current_threshold_cases, percent_of_enrollment, recovered, active_cases,
    st_recovered, active_school_transmitted FROM b)"""


@query(f"{school_panel_sql(START, False)} SELECT * FROM panel")
def school_panel(spark, sf_dir):
    return P.school_panel(
        cohort(spark, sf_dir), AS_OF, START_DAY, school_sizes(spark, sf_dir)
    )


@query(f"{school_panel_sql('1998-03-01', True)} SELECT * FROM panel")
def school_panel_literal(spark, sf_dir):
    return P.school_panel(
        cohort(spark, sf_dir),
        AS_OF,
        dt.date(1998, 3, 1),
        school_sizes(spark, sf_dir),
        literal=True,
    )


@query(f"{district_panel_sql(START, False)} SELECT * FROM panel")
def district_panel(spark, sf_dir):
    return P.district_panel(
        cohort(spark, sf_dir), AS_OF, START_DAY, district_sizes(spark, sf_dir)
    )


@query(f"{district_panel_sql(START, True)} SELECT * FROM panel")
def district_panel_literal(spark, sf_dir):
    return P.district_panel(
        cohort(spark, sf_dir), AS_OF, START_DAY, district_sizes(spark, sf_dir), literal=True
    )


_BOTH = (
    f"SELECT * FROM ({school_panel_sql(START, False)} SELECT {{cols}}, district, FALSE AS "
    f"is_total FROM panel) UNION ALL SELECT * FROM ({district_panel_sql(START, False)} "
    "SELECT {cols}, school AS district, TRUE AS is_total FROM panel)"
)


@query(
    f"SELECT district, {', '.join(SUMMARY)}, is_total FROM "
    f"({_BOTH.format(cols=', '.join(('date', *SUMMARY)))}) WHERE date = DATE '{AS_OF}'"
)
def latest_summary(spark, sf_dir):
    return P.latest_summary(
        school_panel(spark, sf_dir), district_panel(spark, sf_dir), AS_OF
    )


@query(
    f"SELECT {', '.join(DRILLDOWN)}, concat_ws(' ', 'COVID-19 Progression at', school) AS title "
    f"FROM ({_BOTH.format(cols=', '.join(DRILLDOWN))})"
)
def drilldown(spark, sf_dir):
    return P.drilldown(school_panel(spark, sf_dir), district_panel(spark, sf_dir))


# ---------------------------------------------------------------- lists

_PREVIOUS_COHORT = (
    "SELECT * REPLACE (CASE WHEN corona_pui_col_covid_sympt = 'No' THEN NULL "
    f"ELSE corona_pui_col_covid_sympt END AS corona_pui_col_covid_sympt) FROM ({COHORT_SQL}) "
    f"WHERE covid_case_date < DATE '{SNAPSHOT_CUTOFF}'"
)
_DELTA_SQL = (
    f"WITH c AS ({COHORT_SQL}), p AS ({_PREVIOUS_COHORT}), "
    "u AS (SELECT * FROM c UNION SELECT * FROM p), delta AS (SELECT * FROM u WHERE "
    "patient_record_number IN (SELECT patient_record_number FROM u GROUP BY 1 "
    "HAVING count(*) = 1))"
)


def previous_cohort(spark, sf_dir):
    before = cohort(spark, sf_dir).filter(F.col("covid_case_date") < SNAPSHOT_CUTOFF)
    return before.withColumn(
        "corona_pui_col_covid_sympt",
        F.expr("CASE WHEN corona_pui_col_covid_sympt = 'No' THEN NULL "
               "ELSE corona_pui_col_covid_sympt END"),
    )


@query(f"{_DELTA_SQL} SELECT * FROM delta")
def k12_delta(spark, sf_dir):
    return delta_of(
        cohort(spark, sf_dir), previous_cohort(spark, sf_dir), "patient_record_number"
    )


def _sent_sql(source: str) -> str:
    return (
        f"SELECT y.*, r.recipient FROM ({source}) y JOIN ({RECIPIENTS_SQL}) r ON "
        "(r.kind = 'district' AND r.value = y.district) OR "
        "(r.kind = 'school' AND r.value = y.school)"
    )


@query(
    f"""SELECT recipient, person_first_name AS first_name, person_last_name AS last_name,
    patient_birth_date AS dob, corona_pui_col_school_univ_type AS school_type,
    corona_pui_col_school_univ_type_details AS school_type_detail, place_name AS school,
    first_positive_lab AS test_collection_date, first_positive_lab + 5 AS isolate_through,
    first_positive_lab + 6 AS can_return_on FROM ({_sent_sql(
        f"SELECT * FROM ({COHORT_SQL}) WHERE covid_case_date >= DATE '{SNAPSHOT_CUTOFF}'")})"""
)
def case_notices(spark, sf_dir):
    new = new_records(
        cohort(spark, sf_dir), previous_cohort(spark, sf_dir), "patient_record_number"
    )
    return P.case_notices(new, recipients(spark, sf_dir))


def _line_list_sql(extra: str = "") -> str:
    source = (
        f"SELECT * FROM ({COHORT_SQL}) WHERE covid_case_date >= DATE '{AS_OF}' - {LIST_DAYS}"
    )
    return f"""SELECT recipient, person_first_name AS first_name, person_last_name AS last_name,
    patient_birth_date AS dob, covid_case_date AS test_report_date,
    corona_pui_col_school_univ_type AS school_type,
    corona_pui_col_school_univ_type_details AS school_type_detail, place_name AS school, district,
    CASE WHEN corona_pui_col_covid_sympt IN ('Yes', 'No') THEN corona_pui_col_covid_sympt
    ELSE 'Unknown' END AS symptoms, patient_event_onset_date AS onset_date,
    patient_event_onset_date - 2 AS infectious_start_date,
    corona_pui_col_school_univ_event AS contact_tracing_needed,
    corona_pui_col_school_univ_event_details AS tracing_details,
    corona_pui_col_school_univ_activity AS extracurriculars,
    corona_pui_col_school_univ_activities_details AS ext_other,
    corona_pui_col_school_univ_bus_details AS bus,
    patient_event_onset_date + 10 AS isolate_through FROM ({_sent_sql(source)}) {extra}"""


@query(_line_list_sql())
def line_list_14d(spark, sf_dir):
    return P.line_list(cohort(spark, sf_dir), AS_OF, recipients(spark, sf_dir))


_MINOR_COLS = (
    "patient_record_number, person_last_name, person_first_name, first_positive_lab, "
    "patient_birth_date, address_at_diagnosis_county, address_at_diagnosis_city"
)
_MINORS_SQL = f"""SELECT CASE WHEN address_at_diagnosis_county = 'BE' THEN 'box_elder'
    WHEN address_at_diagnosis_county = 'RI' THEN 'rich'
    WHEN address_at_diagnosis_city = 'Logan' THEN 'logan' ELSE 'cache' END AS area, {_MINOR_COLS}
    FROM ({LINKED_SQL}) WHERE patient_age_at_event_in_years BETWEEN 5 AND 17 AND place_name = ''
    AND covid_case_date >= CASE WHEN address_at_diagnosis_county = 'CA' THEN DATE '2021-08-18'
    ELSE DATE '2021-08-30' END"""


def shifted(spark, sf_dir):
    """Linked cases moved into the school year the follow-up lists are about."""
    rows = linked(spark, sf_dir)
    return rows.withColumns(
        {
            "covid_case_date": F.expr("covid_case_date + INTERVAL 9000 DAY"),
            "patient_birth_date": F.expr("patient_birth_date + INTERVAL 9000 DAY"),
            "place_name": F.expr(
                "CASE WHEN corona_pui_col_covid_sympt = 'Yes' THEN place_name ELSE '' END"
            ),
        }
    )


SHIFTED_SQL = (
    "SELECT * REPLACE (covid_case_date + 9000 AS covid_case_date, patient_birth_date + 9000 AS "
    "patient_birth_date, CASE WHEN corona_pui_col_covid_sympt = 'Yes' THEN place_name ELSE '' END "
    f"AS place_name) FROM ({LINKED_SQL})"
)
_MINORS_SQL = _MINORS_SQL.replace(LINKED_SQL, SHIFTED_SQL)


@query(_MINORS_SQL)
def uninvestigated_minors(spark, sf_dir):
    return P.uninvestigated_minors(shifted(spark, sf_dir))


@query(
    f"""WITH c AS (SELECT * REPLACE (CASE person_last_name WHEN 'NATION_3' THEN
    concat(patient_record_number, '-new') ELSE patient_record_number END AS patient_record_number)
    FROM ({_MINORS_SQL})),
    p AS (SELECT * FROM ({_MINORS_SQL}) WHERE first_positive_lab < DATE '2001-01-01'),
    u AS (SELECT * FROM c UNION ALL SELECT * FROM p)
    SELECT * FROM u WHERE (area, patient_record_number) IN (SELECT (area, patient_record_number)
    FROM u GROUP BY area, patient_record_number HAVING count(*) = 1)"""
)
def minors_delta(spark, sf_dir):
    minors = uninvestigated_minors(spark, sf_dir)
    return P.minors_delta(
        minors.withColumn("patient_record_number", F.expr(
            "IF(person_last_name = 'NATION_3', concat(patient_record_number, '-new'), "
            "patient_record_number)")),
        minors.filter(F.col("first_positive_lab") < "2001-01-01"),
    )


@query(
    f"""SELECT patient_record_number, covid_case_date FROM ({SHIFTED_SQL})
    WHERE covid_case_date >= DATE '2021-08-30' AND corona_pui_col_school_univ = 'Yes'
    AND place_name = ''"""
)
def missing_school(spark, sf_dir):
    return P.missing_school(shifted(spark, sf_dir)).select(
        "patient_record_number", "covid_case_date"
    )


@query(
    f"""SELECT {', '.join(SLICE)} FROM ({SHIFTED_SQL}) WHERE
    patient_jurisdiction_of_investigation = 'Utah State' AND covid_interview_complete = 'f'
    AND corona_pui_col_school_univ = 'Yes' AND patient_birth_date <= DATE '2009-11-02'
    AND covid_case_date >= DATE '2021-11-05' AND corona_pui_col_school_univ_type NOT IN
    ('Volunteer/visitor', 'volunteer-visitor') AND exposure_place_school_district IN
    (SELECT exposure_district FROM ({DISTRICTS_SQL}))"""
)
def adults_to_reroute(spark, sf_dir):
    return P.adults_to_reroute(
        shifted(spark, sf_dir),
        born_by=dt.date(2009, 11, 2),
        districts=exposure_districts(spark, sf_dir),
    )


@query(
    f"""SELECT {', '.join(SLICE)} FROM ({COHORT_SQL}) WHERE place_name IN ('NATION_2',
    'NATION_2 School') AND covid_case_date >= DATE '{AS_OF}' - 365"""
)
def school_slice(spark, sf_dir):
    return P.school_slice(
        cohort(spark, sf_dir), ["NATION_2", "NATION_2 School"], AS_OF, days=365
    )
