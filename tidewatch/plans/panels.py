"""Daily, weekly and monthly panels, long by region.

``operators.widen`` turns any of them into one column per region and metric.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_date, date_lit, rate, safe_ratio
from ..operators import (
    count_where,
    cumulative,
    fill_gaps,
    fill_spine,
    region_spine_counts,
    trailing_mean,
    trailing_sum,
    with_population,
)
from ..operators.panel import TOTAL
from ..sources import date_spine, dimension
from ..sources.dimensions import dimension_table

# First day of each panel and the age bands of the extracts.
CASES_START = dt.date(2020, 3, 1)
CASE_WEEKS_START = dt.date(2020, 3, 29)
DEATH_WEEKS_START = dt.date(2020, 3, 29)
HOSPITAL_WEEKS_START = dt.date(2020, 3, 15)
AGE_BANDS = {
    "0-1": "age_under_1",
    "1-14": "age_1_14",
    "15-24": "age_15_24",
    "25-44": "age_25_44",
    "45-64": "age_45_64",
    "65-84": "age_65_84",
    "85+": "age_85_up",
}


def counties() -> list[str]:
    return dimension_table("county").column("county").to_pylist()


def by_county(county: str) -> dict[str, Column]:
    """The district, which every row belongs to, and its counties by name."""
    return {TOTAL: F.lit(True), **{name: F.col(county) == name for name in counties()}}


def _status_and_age() -> dict[str, Column]:
    return {
        "vaccinated": F.col("breakthrough") == "Yes",
        "unvaccinated": F.col("breakthrough") == "No",
        **{name: F.col("age") == band for band, name in AGE_BANDS.items()},
    }


def _weekly(
    events: DataFrame,
    week: str,
    counted: Column,
    start: dt.date,
    end: dt.date,
    names: tuple[str, str, str],
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    new, total, mean = names
    measures = {new: F.lit(True), **_status_and_age(), **(extra or {})}
    spine = date_spine(events.sparkSession, start, end, "week", "week_of")
    dated = events.withColumnRenamed(week, "week_of")
    panel = region_spine_counts(
        dated, spine, "week_of", by_county("county_name"), measures, {(TOTAL, new): counted}
    )
    panel = cumulative(panel, {new: total}, "week_of", "region")
    return trailing_mean(panel, {new: mean}, 4, "week_of", "region")


def deaths_weekly(
    deaths: DataFrame, as_of: dt.date | str, start: dt.date = DEATH_WEEKS_START
) -> DataFrame:
    """Deaths per week of death: by vaccination, age and region, running total, 4-week mean."""
    return _weekly(
        deaths,
        "death_week",
        F.col("patient_died") == "Yes",
        start,
        as_date(as_of),
        ("weekly_deaths", "total_deaths", "deaths_4wa"),
    )


def hospital_weekly(
    cases: DataFrame, as_of: dt.date | str, start: dt.date = HOSPITAL_WEEKS_START
) -> DataFrame:
    """Hospitalised cases per week of admission."""
    return _weekly(
        cases.filter(F.col("hosp") == "Yes"),
        "hosp_week",
        F.lit(True),
        start,
        as_date(as_of),
        ("weekly_hosp", "total_hosp", "hosp_4wa"),
    )


def deaths_monthly(deaths: DataFrame) -> DataFrame:
    """Deaths per month of the case, with shares by vaccination; spans the months that occur."""
    counts = count_where(
        deaths.withColumnRenamed("death_month", "month").filter(F.col("month").isNotNull()),
        "month",
        monthly_deaths=F.col("patient_died") == "Yes",
        vaccinated=F.col("breakthrough") == "Yes",
        unvaccinated=F.col("breakthrough") == "No",
    )
    panel = fill_gaps(counts, "month", "month")
    return panel.withColumns(
        {
            "vac_perc": safe_ratio("vaccinated", "monthly_deaths", digits=2),
            "unvax_perc": safe_ratio("unvaccinated", "monthly_deaths", digits=2),
        }
    )


def cases_daily(
    cases: DataFrame, as_of: dt.date | str, start: dt.date = CASES_START
) -> DataFrame:
    """Cases per day and region: totals, 7-day mean and sum, shares and per-capita rates."""
    spark = cases.sparkSession
    measures = {
        "new_cases": F.lit(True),
        "vaccinated": F.col("breakthrough") == "Yes",
        "unvaccinated": F.col("breakthrough") == "No",
        "reinfection": F.col("reinfection") == "Yes",
    }
    panel = region_spine_counts(
        cases.withColumnRenamed("case_date", "date"),
        date_spine(spark, start, as_of),
        "date",
        by_county("county_name"),
        measures,
        {(TOTAL, "new_cases"): F.col("st_case_status") == "Confirmed"},
    )
    panel = with_population(panel, dimension(spark, "population"), "region")
    panel = panel.withColumns(
        {
            "nonreinfection": F.col("new_cases") - F.col("reinfection"),
            "per_capita": rate("new_cases", "population"),
            "vac_perc": safe_ratio("vaccinated", "new_cases"),
            "unvax_perc": safe_ratio("unvaccinated", "new_cases"),
            "reinf_perc": safe_ratio("reinfection", "new_cases"),
        }
    ).withColumn("nonreinf_perc", safe_ratio("nonreinfection", "new_cases"))
    panel = cumulative(panel, {"new_cases": "total_cases"}, "date", "region")
    panel = trailing_mean(
        panel, {"new_cases": "mean_7d", "per_capita": "per_capita_7d"}, 7, "date", "region"
    )
    panel = trailing_sum(panel, {"new_cases": "sum_7d"}, 7, "date", "region")
    return panel.withColumn("rate_7d", rate("sum_7d", "population", per=1_000))


def cases_weekly(
    cases: DataFrame, as_of: dt.date | str, start: dt.date = CASE_WEEKS_START
) -> DataFrame:
    """Cases per complete week: as the other weekly panels, with reinfection shares."""
    panel = _weekly(
        cases,
        "case_week",
        F.col("st_case_status") == "Confirmed",
        start,
        as_date(as_of) - dt.timedelta(days=7),
        ("weekly_cases", "total_cases", "cases_4wa"),
        {"reinfection": F.col("reinfection") == "Yes"},
    )
    panel = panel.withColumn("first_infection", F.col("weekly_cases") - F.col("reinfection"))
    shares = {
        "vac_perc": "vaccinated",
        "unvax_perc": "unvaccinated",
        "reinf_perc": "reinfection",
        "firstinf_perc": "first_infection",
    }
    return panel.withColumns(
        {name: safe_ratio(part, "weekly_cases", digits=2) for name, part in shares.items()}
    )


def city_daily(
    investigations: DataFrame,
    as_of: dt.date | str,
    start: dt.date = CASES_START,
    city: str = "city",
    population: DataFrame | None = None,
) -> DataFrame:
    """Cases per day and city with the rate per 100,000 and 7-day means of both.

    The spine runs to the last case date found, while only cases up to ``as_of`` count. Pass
    the raw column as ``city`` to count it without normalisation.
    """
    population = population or dimension(investigations.sparkSession, "city_population")
    counts = (
        investigations.filter(F.col("covid_case_date").isNotNull())
        .groupBy(F.col("covid_case_date").alias("date"), F.col(city).alias("city"))
        .agg(F.count("*").alias("cases"))
    )
    # Taking the maximum together with the count keeps both uses of ``counts`` the same plan, so
    # the aggregation runs once.
    last = counts.agg(F.max(F.struct("date", "cases"))["date"]).scalar()
    grid = (
        population.withColumn("_last", last)
        .filter(F.col("_last") >= date_lit(start))
        .select(
            F.explode(F.sequence(date_lit(start), F.col("_last"))).alias("date"),
            "city",
            "population",
        )
    )
    panel = fill_spine(grid, counts, ["date", "city"]).withColumn(
        "cases", F.when(F.col("date") <= date_lit(as_of), F.col("cases")).otherwise(0)
    )
    panel = panel.withColumn(
        "per_capita", F.coalesce(rate("cases", "population"), F.lit(0.0))
    )
    return trailing_mean(
        panel, {"per_capita": "per_capita_7d", "cases": "mean_7d"}, 7, "date", "city"
    )


def positivity_daily(
    tests: DataFrame,
    date: str,
    as_of: dt.date | str,
    home: str,
    start: dt.date = CASES_START,
    district: str = "lhd",
    county: str = "county",
) -> DataFrame:
    """Tests, positives and positivity per day; the 7-day figure is the mean of daily ratios.

    ``date`` chooses the basis: collection date counts by person, case date by test. District
    tests go by the district column, district positives by result alone.
    """
    panel = region_spine_counts(
        tests.withColumnRenamed(date, "date"),
        date_spine(tests.sparkSession, start, as_of),
        "date",
        by_county(county),
        {"tests": F.lit(True), "positives": F.col("test_result") == "POSITIVE"},
        {(TOTAL, "tests"): F.col(district) == home},
    )
    panel = panel.withColumn("positivity", safe_ratio("positives", "tests", fill=0))
    panel = cumulative(panel, {"tests": "total_tests"}, "date", "region")
    panel = trailing_mean(
        panel, {"positivity": "positivity_7d"}, 7, "date", "region", scale=100
    )
    return trailing_mean(panel, {"tests": "tests_7d"}, 7, "date", "region")


def pooled_positivity(panel: DataFrame, k: int = 7) -> DataFrame:
    """Alternative 7-day figure: positives over tests of the whole period, in percent."""
    out = trailing_sum(panel, {"tests": "_t", "positives": "_p"}, k, "date", "region")
    return out.withColumn(
        f"pooled_{k}d", safe_ratio("_p", "_t", scale=100, digits=1)
    ).drop("_t", "_p")
