"""Chart-ready series: one long table per published chart and language."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chart_series, flag_provisional
from ..operators.panel import TOTAL
from .panels import AGE_BANDS
from .scorecards import labels

DEATHS_LAG = 14
HOSPITAL_LAG = 7


@dataclass(frozen=True)
class Chart:
    """Which panel a chart draws, and whether its series are metrics or regions."""

    panel: str
    x: str
    y_axis: str
    metrics: tuple[str, ...]
    regions: tuple[str, ...] = ()
    key: str = "region"
    where: tuple[tuple[str, str], ...] = ()
    note: str | None = None
    lag: int | None = None


_COUNTIES = ("Box Elder", "Cache", "Rich")
_ALL = (TOTAL, *_COUNTIES)
_AGES = tuple(reversed(AGE_BANDS.values()))
_VACCINATION = ("vaccinated", "unvaccinated")
_ADULT_AGES = _AGES[:5]


def _deaths(metrics: tuple[str, ...], regions: tuple[str, ...] = ()) -> Chart:
    return Chart(
        "deaths_weekly", "week_of", "deaths_axis", metrics, regions,
        note="deaths_note", lag=DEATHS_LAG,
    )


def _hospital(metrics: tuple[str, ...], regions: tuple[str, ...] = ()) -> Chart:
    return Chart(
        "hospital_weekly", "week_of", "hospital_axis", metrics, regions,
        note="hospital_note", lag=HOSPITAL_LAG,
    )


def _weekly(axis: str, *metrics: str) -> Chart:
    return Chart("cases_weekly", "week_of", axis, metrics)


def _daily(axis: str, metric: str) -> Chart:
    return Chart("cases_daily", "date", axis, (metric,), _ALL)


def _coverage(dose: str, band: str) -> Chart:
    return Chart(
        "coverage", "date", "percent_axis", ("percent",), _ALL,
        where=(("dose", dose), ("band", band)),
    )


CHARTS: dict[str, Chart] = {
    "weekly_deaths": _deaths(("weekly_deaths", "deaths_4wa")),
    "deaths_by_vaccination": _deaths(_VACCINATION),
    "deaths_by_county": _deaths(("weekly_deaths",), _COUNTIES),
    "deaths_by_age": _deaths(_ADULT_AGES),
    "monthly_deaths_by_vaccination": Chart(
        "deaths_monthly", "month", "deaths_axis", _VACCINATION,
        note="deaths_note", lag=DEATHS_LAG,
    ),
    "weekly_hospitalizations": _hospital(("weekly_hosp", "hosp_4wa")),
    "hospitalizations_by_vaccination": _hospital(_VACCINATION),
    "hospitalizations_by_county": _hospital(("weekly_hosp",), _COUNTIES),
    "hospitalizations_by_age": _hospital(_AGES),
    "weekly_cases": _weekly("new_weekly_axis", "weekly_cases", "cases_4wa"),
    "cases_by_vaccination": _weekly("weekly_axis", *_VACCINATION),
    "cases_by_reinfection": _weekly("weekly_axis", "reinfection", "first_infection"),
    "cases_by_age": _weekly("weekly_axis", *_AGES),
    "cases_per_capita": _daily("new_cases_axis", "per_capita_7d"),
    "cases_mean": _daily("new_cases_axis", "mean_7d"),
    "cases_rate": _daily("rate_axis", "rate_7d"),
    "cities": Chart("city_daily", "date", "daily_axis", ("mean_7d",), ("*",), key="city"),
    "positivity_by_person": Chart(
        "positivity_person", "date", "positivity_axis", ("positivity_7d",), _ALL[:3]
    ),
    "positivity_by_test": Chart(
        "positivity_test", "date", "positivity_axis", ("positivity_7d",), _ALL[:3]
    ),
    "daily_tests": Chart("positivity_person", "date", "tests_axis", ("tests", "tests_7d")),
    "coverage_first": _coverage("first", "5up"),
    "coverage_complete": _coverage("second", "5up"),
    "coverage_booster": _coverage("third", "12up"),
}


def chart_table(chart: Chart, panel: DataFrame, as_of: dt.date | str, lang: str) -> DataFrame:
    """``(x, series, value, provisional)`` with series names in ``lang``."""
    text = labels(lang)
    for col, value in chart.where:
        panel = panel.filter(F.col(col) == value)
    if chart.regions:
        if chart.regions != ("*",):
            panel = panel.filter(F.col(chart.key).isin(*chart.regions))
        suffix = text.get(f"suffix_{chart.metrics[0]}") or ""
        if chart.key != "region":
            suffix = ""
        out = panel.select(
            F.col(chart.x).alias("x"),
            F.concat(F.col(chart.key), F.lit(suffix)).alias("series"),
            F.col(chart.metrics[0]).cast("double").alias("value"),
        )
    else:
        if "region" in panel.columns:
            panel = panel.filter(F.col("region") == TOTAL)
        out = chart_series(
            panel.withColumnRenamed(chart.x, "x"), "x", {m: text[m] for m in chart.metrics}
        )
    if chart.lag is None:
        return out.withColumn("provisional", F.lit(False))
    return flag_provisional(out, "x", as_of, chart.lag)


def chart_captions(lang: str) -> dict[str, dict[str, str | None]]:
    """Axis titles and the reporting-lag note of every chart."""
    text = labels(lang)
    return {
        name: {
            "x": text["date_axis"],
            "y": text[c.y_axis],
            "note": text[c.note] if c.note else None,
        }
        for name, c in CHARTS.items()
    }


def chart_tables(
    panels: Mapping[str, DataFrame], as_of: dt.date | str, lang: str = "en"
) -> dict[str, DataFrame]:
    """Every chart whose panel is given."""
    return {
        name: chart_table(c, panels[c.panel], as_of, lang)
        for name, c in CHARTS.items()
        if c.panel in panels
    }
