"""Surveillance panels, coverage, scorecards and charts over the derived extracts."""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import functions as F

from tidewatch import plans as P
from tidewatch.operators import symmetric_delta, widen
from tidewatch.plans.coverage import FROM_AGE
from tidewatch.plans.extracts import AGE_LABELS, AGE_UPPER, VISIT_ORDER, city_rules
from tidewatch.plans.panels import AGE_BANDS, pooled_positivity
from tidewatch.plans.scorecards import labels
from tidewatch.sources.dimensions import dimension_table

from .derived import (
    AS_OF,
    DOSE_AS_OF,
    DOSE_START,
    HOME,
    SNAPSHOT_CUTOFF,
    START,
    extract,
    extract_sql,
)
from .registry import (
    full_window,
    half_even,
    half_even_units,
    query,
    running,
    spine_sql,
    sunday,
)

START_DAY = dt.date.fromisoformat(START)
WEEK_END = (dt.date.fromisoformat(AS_OF) - dt.timedelta(days=7)).isoformat()
REGIONS = ("District", "Box Elder", "Cache", "Rich")
_COUNTY = (
    "CASE county WHEN 2 THEN 'Box Elder' WHEN 3 THEN 'Cache' WHEN 17 THEN 'Rich' ELSE '' END"
)
_REGION_ROWS = ", ".join(f"('{r}')" for r in REGIONS)
POPULATION_SQL = "(VALUES " + ", ".join(
    f"('{r['region']}', {r['population']}::BIGINT)" for r in dimension_table("population").to_pylist()
) + ") AS pop(region, population)"


# ---------------------------------------------------------------- cleaned extracts


def cases(spark, sf_dir):
    return P.clean_case_extract(extract(spark, sf_dir, "cases"))


def deaths(spark, sf_dir):
    return P.clean_death_extract(extract(spark, sf_dir, "deaths"))


def doses(spark, sf_dir):
    return P.clean_dose_extract(extract(spark, sf_dir, "doses"))


def tests(spark, sf_dir, date):
    return P.clean_test_extract(extract(spark, sf_dir, "tests"), date)


CASES_SQL = (
    f"SELECT * REPLACE (coalesce(breakthrough, '') AS breakthrough), {sunday('case_date')} AS "
    f"case_week, {sunday('hosp_admit_date')} AS hosp_week, {_COUNTY} AS county_name "
    f"FROM ({extract_sql('cases')})"
)
DEATHS_SQL = (
    f"SELECT *, {sunday('date_of_death')} AS death_week, "
    f"CAST(date_trunc('month', case_date) AS DATE) AS death_month, {_COUNTY} AS county_name "
    f"FROM ({extract_sql('deaths')})"
)
TESTS_SQL = (
    "SELECT * REPLACE (coalesce(county, '') AS county), county AS county_name "
    f"FROM ({extract_sql('tests')}) "
    "WHERE test_result IN ('POSITIVE', 'NEGATIVE') AND test_type = 'PCR/amplification'"
)


def region_panel_sql(
    source: str,
    date: str,
    out: str,
    spine: str,
    total: dict[str, str],
    part: dict[str, str],
) -> str:
    """CTEs ending in ``p``: the zero-filled counts per date and region."""
    names = list(total)

    def counts(rules: dict[str, str]) -> str:
        return ", ".join(f'count(*) FILTER ({p}) AS "{n}"' for n, p in rules.items())

    filled = ", ".join(f'CAST(coalesce("{n}", 0) AS BIGINT) AS "{n}"' for n in names)
    return (
        f"WITH x AS ({source}), a AS (SELECT {date} AS {out}, 'District' AS region, "
        f"{counts(total)} FROM x GROUP BY 1 UNION ALL SELECT {date}, county_name, "
        f"{counts(part)} FROM x WHERE county_name IN ('Box Elder', 'Cache', 'Rich') "
        f"GROUP BY 1, 2), g AS (SELECT s.{out}, r.region FROM ({spine}) s, "
        f"(VALUES {_REGION_ROWS}) AS r(region)), p AS (SELECT g.{out}, g.region, {filled} "
        f"FROM g LEFT JOIN a ON g.{out} = a.{out} AND g.region = a.region)"
    )


_SHARED = {
    "vaccinated": "breakthrough = 'Yes'",
    "unvaccinated": "breakthrough = 'No'",
    **{name: f"age = '{band}'" for band, name in AGE_BANDS.items()},
}


def weekly_sql(
    source: str,
    week: str,
    names: tuple[str, str, str],
    counted: str,
    end: str,
    extra: dict[str, str] | None = None,
) -> str:
    new, total, mean = names
    shared = {**_SHARED, **(extra or {})}
    head = region_panel_sql(
        source,
        week,
        "week_of",
        spine_sql(START, end, "7 DAY", "week_of"),
        {new: counted, **shared},
        {new: "TRUE", **shared},
    )
    return (
        f"{head}, w AS (SELECT *, {running(new, 'week_of', 'region')} AS {total}, "
        f"{full_window('sum', new, 4, 'week_of', 'region')} AS s4 FROM p), "
        f"panel AS (SELECT * EXCLUDE (s4), {half_even('s4', '4', 1)} AS {mean} FROM w)"
    )


_DEATH_NAMES = ("weekly_deaths", "total_deaths", "deaths_4wa")
_HOSPITAL_NAMES = ("weekly_hosp", "total_hosp", "hosp_4wa")
_CASE_NAMES = ("weekly_cases", "total_cases", "cases_4wa")
_REINFECTION = {"reinfection": "reinfection = 'Yes'"}
DEATHS_WEEKLY_SQL = weekly_sql(
    DEATHS_SQL, "death_week", _DEATH_NAMES, "patient_died = 'Yes'", AS_OF
)
HOSPITAL_WEEKLY_SQL = weekly_sql(
    f"SELECT * FROM ({CASES_SQL}) WHERE hosp = 'Yes'", "hosp_week", _HOSPITAL_NAMES, "TRUE", AS_OF
)
CASES_WEEKLY_SQL = weekly_sql(
    CASES_SQL, "case_week", _CASE_NAMES, "st_case_status = 'Confirmed'", WEEK_END, _REINFECTION
)


@query(f"{DEATHS_WEEKLY_SQL} SELECT * FROM panel")
def deaths_weekly(spark, sf_dir):
    return P.deaths_weekly(deaths(spark, sf_dir), AS_OF, START_DAY)


@query(f"{HOSPITAL_WEEKLY_SQL} SELECT * FROM panel")
def hospital_weekly(spark, sf_dir):
    return P.hospital_weekly(cases(spark, sf_dir), AS_OF, START_DAY)


@query(
    f"""{CASES_WEEKLY_SQL} SELECT *, weekly_cases - reinfection AS first_infection,
    {half_even('vaccinated', 'weekly_cases', 2)} AS vac_perc,
    {half_even('unvaccinated', 'weekly_cases', 2)} AS unvax_perc,
    {half_even('reinfection', 'weekly_cases', 2)} AS reinf_perc,
    {half_even('(weekly_cases - reinfection)', 'weekly_cases', 2)} AS firstinf_perc FROM panel"""
)
def cases_weekly(spark, sf_dir):
    return P.cases_weekly(cases(spark, sf_dir), AS_OF, START_DAY)


DEATHS_MONTHLY_SQL = f"""WITH x AS ({DEATHS_SQL}), a AS (SELECT death_month AS month,
    count(*) FILTER (patient_died = 'Yes') AS monthly_deaths,
    count(*) FILTER (breakthrough = 'Yes') AS vaccinated,
    count(*) FILTER (breakthrough = 'No') AS unvaccinated FROM x GROUP BY 1),
    b AS (SELECT min(month) lo, max(month) hi FROM a),
    s AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month FROM b),
    p AS (SELECT s.month, coalesce(monthly_deaths, 0) AS monthly_deaths,
    coalesce(vaccinated, 0) AS vaccinated, coalesce(unvaccinated, 0) AS unvaccinated
    FROM s LEFT JOIN a ON s.month = a.month),
    panel AS (SELECT *, {half_even('vaccinated', 'monthly_deaths', 2)} AS vac_perc,
    {half_even('unvaccinated', 'monthly_deaths', 2)} AS unvax_perc FROM p)"""


@query(f"{DEATHS_MONTHLY_SQL} SELECT * FROM panel")
def deaths_monthly(spark, sf_dir):
    return P.deaths_monthly(deaths(spark, sf_dir))


_DAILY_SHARED = {
    "vaccinated": "breakthrough = 'Yes'",
    "unvaccinated": "breakthrough = 'No'",
    "reinfection": "reinfection = 'Yes'",
}
CASES_DAILY_SQL = (
    region_panel_sql(
        CASES_SQL,
        "case_date",
        "date",
        spine_sql(START, AS_OF),
        {"new_cases": "st_case_status = 'Confirmed'", **_DAILY_SHARED},
        {"new_cases": "TRUE", **_DAILY_SHARED},
    )
    + f""", q AS (SELECT p.*, population, new_cases - reinfection AS nonreinfection,
    {half_even_units('new_cases * 100000', 'population', 2)} AS pc FROM p
    JOIN {POPULATION_SQL} ON p.region = pop.region),
    w AS (SELECT *, {running('new_cases', 'date', 'region')} AS total_cases,
    {full_window('sum', 'new_cases', 7, 'date', 'region')} AS s7,
    {full_window('sum', 'pc', 7, 'date', 'region')} AS pc7 FROM q),
    panel AS (SELECT * EXCLUDE (pc, s7, pc7), CAST(pc AS DOUBLE) / 100 AS per_capita,
    vaccinated / NULLIF(CAST(new_cases AS DOUBLE), 0) AS vac_perc,
    unvaccinated / NULLIF(CAST(new_cases AS DOUBLE), 0) AS unvax_perc,
    reinfection / NULLIF(CAST(new_cases AS DOUBLE), 0) AS reinf_perc,
    nonreinfection / NULLIF(CAST(new_cases AS DOUBLE), 0) AS nonreinf_perc,
    {half_even('s7', '7', 1)} AS mean_7d, {half_even('pc7', '700', 1)} AS per_capita_7d,
    CAST(s7 AS BIGINT) AS sum_7d, {half_even('s7 * 1000', 'population', 2)} AS rate_7d FROM w)"""
)


@query(f"{CASES_DAILY_SQL} SELECT * FROM panel")
def cases_daily(spark, sf_dir):
    return P.cases_daily(cases(spark, sf_dir), AS_OF, START_DAY)


_WIDE = {"District": "district", "Box Elder": "box_elder", "Cache": "cache", "Rich": "rich"}


@query(
    f"{CASES_DAILY_SQL} SELECT date, "
    + ", ".join(
        f"max({m}) FILTER (region = '{r}') AS {short}_{m}"
        for r, short in _WIDE.items()
        for m in ("new_cases", "mean_7d")
    )
    + " FROM panel GROUP BY date"
)
def cases_daily_wide(spark, sf_dir):
    return widen(
        cases_daily(spark, sf_dir), "date", "region", _WIDE, ["new_cases", "mean_7d"]
    )


def _city_case(c: str) -> str:
    rules = " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{v}'" for p, v in city_rules())
    return f"CASE {rules} ELSE {c} END"


_AGE_CASE = " ".join(
    f"WHEN patient_age_at_event_in_years < {u} THEN '{label}'"
    for u, label in zip(AGE_UPPER, AGE_LABELS)
)
_VISIT_CASE = " ".join(
    f"WHEN person_facility_visit_type = '{v}' THEN {i}" for i, v in enumerate(VISIT_ORDER)
)
_TIEBREAK = ("line", "part", "supplier", "amount")
INVESTIGATIONS_SQL = (
    f"SELECT * EXCLUDE (rn), {sunday('covid_case_date')} AS week_of, "
    f"CAST((dayofyear({sunday('covid_case_date')} + 3) - 1) // 7 + 1 AS INTEGER) AS epi_week, "
    f"CAST(year({sunday('covid_case_date')} + 3) AS INTEGER) AS epi_year, "
    f"CASE {_AGE_CASE} ELSE 'Unknown' END AS agecat, "
    f"{_city_case('address_at_diagnosis_city')} AS city, CASE WHEN corona_pui_col_hosp_ncov = "
    "'Yes' OR corona_pui_col_icu = 'Yes' OR person_facility_visit_type = 'Inpatient' THEN 1 "
    "ELSE 0 END AS hospitalized FROM (SELECT *, row_number() OVER (PARTITION BY "
    f"patient_record_number ORDER BY CASE {_VISIT_CASE} ELSE {len(VISIT_ORDER)} END, "
    f"{', '.join(_TIEBREAK)}) AS rn FROM ({extract_sql('investigations')}) "
    "WHERE patient_jurisdiction_of_residence IN ('Home', '') AND (patient_state_case_status = "
    "'Confirmed' OR condition_caused_death = 'Yes')) WHERE rn = 1"
)


def investigations(spark, sf_dir):
    return P.clean_investigations(extract(spark, sf_dir, "investigations"), HOME, _TIEBREAK)


@query(INVESTIGATIONS_SQL)
def clean_investigations(spark, sf_dir):
    return investigations(spark, sf_dir)


@query(
    f"""WITH x AS ({INVESTIGATIONS_SQL}), l AS (SELECT patient_record_number, first_positive_lab,
    case_onset_date FROM ({extract_sql('cases')}))
    SELECT coalesce(l.patient_record_number, x.patient_record_number) AS patient_record_number,
    l.first_positive_lab, l.case_onset_date, x.covid_case_date, x.agecat, x.hospitalized
    FROM l FULL JOIN x ON l.patient_record_number = x.patient_record_number"""
)
def link_collection_date(spark, sf_dir):
    return P.link_collection_date(
        extract(spark, sf_dir, "cases"), investigations(spark, sf_dir)
    ).select(
        "patient_record_number",
        "first_positive_lab",
        "case_onset_date",
        "covid_case_date",
        "agecat",
        "hospitalized",
    )


_CITIES = ", ".join(
    f"('{r['city']}', {r['population']}::BIGINT)" for r in dimension_table("city_population").to_pylist()
)
CITY_DAILY_SQL = f"""WITH x AS ({INVESTIGATIONS_SQL}), s AS (SELECT CAST(unnest(generate_series(
    DATE '{START}', max(covid_case_date), INTERVAL 1 DAY)) AS DATE) AS date FROM x),
    a AS (SELECT covid_case_date AS date, city, count(*) AS n FROM x
    WHERE covid_case_date <= DATE '{AS_OF}' GROUP BY 1, 2),
    p AS (SELECT s.date, t.city, t.population, CAST(coalesce(n, 0) AS BIGINT) AS cases
    FROM s CROSS JOIN (VALUES {_CITIES}) AS t(city, population)
    LEFT JOIN a ON a.date = s.date AND a.city = t.city),
    q AS (SELECT *, coalesce({half_even_units('cases * 100000', 'population', 2)}, 0) AS pc FROM p),
    w AS (SELECT *, {full_window('sum', 'pc', 7, 'date', 'city')} AS pc7,
    {full_window('sum', 'cases', 7, 'date', 'city')} AS s7 FROM q),
    panel AS (SELECT date, city, population, cases, CAST(pc AS DOUBLE) / 100 AS per_capita,
    {half_even('pc7', '700', 1)} AS per_capita_7d, {half_even('s7', '7', 1)} AS mean_7d FROM w)"""


@query(f"{CITY_DAILY_SQL} SELECT * FROM panel")
def city_daily(spark, sf_dir):
    return P.city_daily(investigations(spark, sf_dir), AS_OF, START_DAY)


@functools.cache
def positivity_sql(date: str) -> str:
    head = region_panel_sql(
        TESTS_SQL,
        date,
        "date",
        spine_sql(START, AS_OF),
        {"tests": f"lhd = '{HOME}'", "positives": "test_result = 'POSITIVE'"},
        {"tests": "TRUE", "positives": "test_result = 'POSITIVE'"},
    )
    return (
        f"{head}, q AS (SELECT *, coalesce(positives / NULLIF(CAST(tests AS DOUBLE), 0), 0) AS "
        f"positivity FROM p), w AS (SELECT *, {running('tests', 'date', 'region')} AS total_tests, "
        f"{full_window('avg', 'positivity', 7, 'date', 'region')} AS m7, "
        f"{full_window('sum', 'tests', 7, 'date', 'region')} AS t7, "
        f"{full_window('sum', 'positives', 7, 'date', 'region')} AS p7 FROM q), "
        "panel AS (SELECT date, region, tests, positives, positivity, total_tests, "
        "round_even(CAST(round(100 * m7, 9) AS DOUBLE), 1) AS positivity_7d, "
        f"{half_even('t7', '7', 1)} AS tests_7d, {half_even('p7 * 100', 't7', 1)} AS pooled_7d "
        "FROM w)"
    )


@query(f"{positivity_sql('collect_date_fillrph')} SELECT * EXCLUDE (pooled_7d) FROM panel")
def positivity_person(spark, sf_dir):
    date = "collect_date_fillrph"
    return P.positivity_daily(tests(spark, sf_dir, date), date, AS_OF, HOME, START_DAY)


@query(f"{positivity_sql('case_date')} SELECT * EXCLUDE (pooled_7d) FROM panel")
def positivity_test(spark, sf_dir):
    date = "case_date"
    return P.positivity_daily(tests(spark, sf_dir, date), date, AS_OF, HOME, START_DAY)


@query(f"{positivity_sql('case_date')} SELECT date, region, pooled_7d FROM panel")
def positivity_pooled(spark, sf_dir):
    return pooled_positivity(positivity_test(spark, sf_dir)).select("date", "region", "pooled_7d")


# ---------------------------------------------------------------- coverage

_BANDS = dimension_table("coverage_band").to_pylist()
_COVERAGE_POP = dimension_table("coverage_population").to_pylist()


def _band_member(band: str) -> str:
    if band == "all":
        return "TRUE"
    if band in FROM_AGE:
        return f"age_original >= {FROM_AGE[band]}"
    rule = next(r for r in _BANDS if r["band"] == band)
    return f"{'age' if rule['kind'] == 'age' else 'race_eth'} = '{rule['value']}'"


def coverage_sql() -> str:
    regions = {r: f"county = '{r}'" for r in REGIONS[1:]} | {"District": f"district = '{HOME}'"}
    dose_rules = {
        "first": "dose_all = 1",
        "second": "vaccine_status = 'Complete'",
        "third": "booster_dose = 'Yes'",
    }
    bands = {
        r: [(p["band"], p["population"]) for p in _COVERAGE_POP if p["region"] == r]
        + [("unknown_age", None)]
        + ([("unknown_race", None)] if r == "District" else [])
        for r in regions
    }
    series = [
        (r, d, b, pop, f"{rp} AND {dp} AND {_band_member(b)}")
        for r, rp in regions.items()
        for d, dp in dose_rules.items()
        for b, pop in bands[r]
        if not (d == "third" and b == "5up")
    ] + [(r, "total", "all", None, rp) for r, rp in regions.items()]
    rows = ", ".join(
        f"('{r}', '{d}', '{b}', {'NULL' if pop is None else pop})" for r, d, b, pop, _ in series
    )
    counted = " UNION ALL ".join(
        f"SELECT vaccine_date AS date, '{r}' AS region, '{d}' AS dose, '{b}' AS band, count(*) AS n "
        f"FROM x WHERE {rule} GROUP BY 1"
        for r, d, b, _, rule in series
    )
    return f"""WITH x AS (SELECT *, CASE WHEN ethnicity = 'Hispanic or Latino'
    THEN 'Hispanic or Latino' ELSE race END AS race_eth FROM ({extract_sql('doses')})),
    a AS ({counted}), g AS (SELECT s.date, v.* FROM ({spine_sql(DOSE_START, DOSE_AS_OF)}) s,
    (VALUES {rows}) AS v(region, dose, band, population)),
    p AS (SELECT g.date, g.region, g.dose, g.band, CAST(g.population AS BIGINT) AS population,
    CAST(coalesce(n, 0) AS BIGINT) AS doses FROM g LEFT JOIN a ON g.date = a.date
    AND g.region = a.region AND g.dose = a.dose AND g.band = a.band),
    w AS (SELECT *, {running('doses', 'date', 'region, dose, band')} AS total FROM p),
    panel AS (SELECT *, {half_even('total * 100', 'population', 2)} AS percent FROM w)"""


COVERAGE_SQL = coverage_sql()


@query(f"{COVERAGE_SQL} SELECT * FROM panel")
def coverage(spark, sf_dir):
    return P.coverage_panel(
        doses(spark, sf_dir), DOSE_AS_OF, HOME, dt.date.fromisoformat(DOSE_START)
    )


# ---------------------------------------------------------------- scorecards

_ORDER_CASE = (
    "CASE region WHEN 'Box Elder' THEN 1 WHEN 'Cache' THEN 2 WHEN 'Rich' THEN 3 ELSE 4 END"
)


def _count_rows(source: str, name: str) -> str:
    return (
        f"SELECT 'District' AS region, count(*) FILTER (lhd = 1) AS {name} FROM ({source}) "
        f"UNION ALL SELECT county_name, count(*) FROM ({source}) WHERE county_name <> '' GROUP BY 1"
    )


def _last_sql(panel_sql: str, date: str, metric: str, name: str) -> str:
    return (
        f"SELECT * FROM ({panel_sql} SELECT region, arg_max({metric}, {date}) AS {name} "
        "FROM panel GROUP BY 1)"
    )


SCORECARD_SQL = f"""WITH d AS ({_count_rows(DEATHS_SQL, 'total_deaths')}),
    h AS ({_count_rows(f"SELECT * FROM ({CASES_SQL}) WHERE hosp = 'Yes'", 'total_hospitalizations')}),
    c AS ({_count_rows(CASES_SQL, 'total_cases')}),
    wk AS ({_last_sql(CASES_WEEKLY_SQL, 'week_of', 'weekly_cases', 'new_weekly_cases')}),
    dy AS ({_last_sql(CASES_DAILY_SQL, 'date', 'mean_7d', 'mean_7d')}),
    ps AS ({_last_sql(positivity_sql('case_date'), 'date', 'positivity_7d', 'positivity_7d')}),
    card AS (SELECT region, total_deaths, total_hospitalizations, total_cases, new_weekly_cases,
    mean_7d, positivity_7d, CAST({_ORDER_CASE} AS INTEGER) AS position FROM d JOIN h USING (region)
    JOIN c USING (region) JOIN wk USING (region) JOIN dy USING (region) JOIN ps USING (region))"""


@query(f"{SCORECARD_SQL} SELECT * FROM card")
def scorecard(spark, sf_dir):
    case_rows = cases(spark, sf_dir)
    return P.regional_scorecard(
        deaths(spark, sf_dir),
        case_rows,
        cases_weekly(spark, sf_dir),
        cases_daily(spark, sf_dir),
        positivity_test(spark, sf_dir),
    )


_ES = labels("es")


@query(
    f"{SCORECARD_SQL} SELECT position, "
    + ", ".join(
        f'{c} AS "{_ES[c]}"'
        for c in (
            "region",
            "total_deaths",
            "total_hospitalizations",
            "total_cases",
            "new_weekly_cases",
            "mean_7d",
            "positivity_7d",
        )
    )
    + " FROM card"
)
def scorecard_es(spark, sf_dir):
    return P.labelled(scorecard(spark, sf_dir), "es")


_DOSE_CARD = f"""{COVERAGE_SQL} SELECT region,
    max(total) FILTER (dose = 'total') AS {{0}},
    CAST(trunc(max(percent) FILTER (dose = 'second' AND band = '5up')) AS INTEGER) AS {{1}},
    CAST(trunc(max(percent) FILTER (dose = 'first' AND band = '5up')) AS INTEGER) AS {{2}},
    CAST({_ORDER_CASE} AS INTEGER) AS position FROM panel WHERE date = DATE '{DOSE_AS_OF}'
    GROUP BY region"""
_DOSE_COLUMNS = ("total_doses", "percent_complete_5up", "percent_first_5up")


@query(_DOSE_CARD.format(*_DOSE_COLUMNS))
def dose_scorecard(spark, sf_dir):
    return P.dose_scorecard(coverage(spark, sf_dir), DOSE_AS_OF)


@query(
    _DOSE_CARD.format(*[f'"{_ES[c]}"' for c in _DOSE_COLUMNS]).replace(
        "SELECT region,\n", f'SELECT region AS "{_ES["region"]}",\n'
    )
)
def dose_scorecard_es(spark, sf_dir):
    return P.labelled(dose_scorecard(spark, sf_dir), "es")


# ---------------------------------------------------------------- hospital delta

_HOSPITAL_COLUMNS = (
    "patient_record_number, hosp_admit_date, first_positive_lab, condition_caused_death, covid_death"
)
_PREVIOUS_DEATH = "CASE WHEN age = '85+' THEN 'No' ELSE covid_death END"


@query(
    f"""WITH c AS (SELECT {_HOSPITAL_COLUMNS} FROM ({CASES_SQL}) WHERE hosp = 'Yes'),
    p AS (SELECT patient_record_number, hosp_admit_date, first_positive_lab,
    condition_caused_death, {_PREVIOUS_DEATH} AS covid_death FROM ({CASES_SQL}) WHERE hosp = 'Yes'
    AND case_date < DATE '{SNAPSHOT_CUTOFF}'), u AS (SELECT * FROM c UNION SELECT * FROM p)
    SELECT * FROM u WHERE patient_record_number IN
    (SELECT patient_record_number FROM u GROUP BY 1 HAVING count(*) = 1)"""
)
def hospital_delta(spark, sf_dir):
    hospital = cases(spark, sf_dir).filter(F.col("hosp") == "Yes")
    previous = hospital.filter(F.col("case_date") < SNAPSHOT_CUTOFF).selectExpr(
        "patient_record_number",
        "hosp_admit_date",
        "first_positive_lab",
        "condition_caused_death",
        f"{_PREVIOUS_DEATH} AS covid_death",
    )
    return symmetric_delta(
        hospital.select(*_HOSPITAL_COLUMNS.split(", ")), previous, "patient_record_number"
    )


# ---------------------------------------------------------------- charts


PANELS = {
    "deaths_weekly": deaths_weekly,
    "deaths_monthly": deaths_monthly,
    "hospital_weekly": hospital_weekly,
    "cases_weekly": cases_weekly,
    "cases_daily": cases_daily,
    "city_daily": city_daily,
    "positivity_person": positivity_person,
    "positivity_test": positivity_test,
    "coverage": coverage,
}
_LABELS = {lang: labels(lang) for lang in ("en", "es")}
_PANEL_SQL = {
    "deaths_weekly": DEATHS_WEEKLY_SQL,
    "deaths_monthly": DEATHS_MONTHLY_SQL,
    "hospital_weekly": HOSPITAL_WEEKLY_SQL,
    "cases_weekly": CASES_WEEKLY_SQL.replace(
        "panel AS (SELECT * EXCLUDE (s4),",
        "panel AS (SELECT * EXCLUDE (s4), weekly_cases - reinfection AS first_infection,",
    ),
    "cases_daily": CASES_DAILY_SQL,
    "city_daily": CITY_DAILY_SQL,
    "positivity_person": positivity_sql("collect_date_fillrph"),
    "positivity_test": positivity_sql("case_date"),
    "coverage": COVERAGE_SQL,
}


def _chart_sql(name: str, lang: str) -> str:
    chart, text = P.CHARTS[name], _LABELS[lang]
    where = " AND ".join(f"{c} = '{v}'" for c, v in chart.where) or "TRUE"
    late = "FALSE"
    if chart.lag is not None:
        late = f"{chart.x} >= CAST(DATE '{AS_OF}' - INTERVAL {chart.lag} DAY AS DATE)"
    head = _PANEL_SQL[chart.panel]
    if chart.regions:
        suffix = text.get(f"suffix_{chart.metrics[0]}") or ""
        if chart.key != "region":
            suffix = ""
        names = ", ".join(f"'{r}'" for r in chart.regions)
        chosen = "TRUE" if chart.regions == ("*",) else f"{chart.key} IN ({names})"
        return (
            f"{head} SELECT {chart.x} AS x, concat({chart.key}, '{suffix}') AS series, "
            f"CAST({chart.metrics[0]} AS DOUBLE) AS value, {late} AS provisional FROM panel "
            f"WHERE {where} AND {chosen}"
        )
    district = "TRUE" if chart.panel == "deaths_monthly" else "region = 'District'"
    parts = " UNION ALL ".join(
        f"SELECT {chart.x} AS x, '{text[m]}' AS series, CAST({m} AS DOUBLE) AS value, "
        f"{late} AS provisional FROM panel WHERE {district}"
        for m in chart.metrics
    )
    return f"{head} {parts}"


def _register_chart(name: str, lang: str) -> None:
    chart = P.CHARTS[name]
    as_of = DOSE_AS_OF if chart.panel == "coverage" else AS_OF
    source = PANELS[chart.panel]

    def run(spark, sf_dir):
        panels = {chart.panel: source(spark, sf_dir)}
        return P.chart_tables(panels, as_of, lang)[name]

    query(_chart_sql(name, lang), name=f"chart_{name}_{lang}")(run)


for _name in P.CHARTS:
    for _lang in ("en", "es"):
        _register_chart(_name, _lang)
