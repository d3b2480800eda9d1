"""Regional scorecards."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import date_lit, int_trunc
from ..operators import relabel, scorecard
from ..operators.panel import TOTAL
from ..sources.dimensions import dimension_table
from .panels import counties

# Fixed value: order of the regions in the published tables.
REGION_ORDER = ("Box Elder", "Cache", "Rich", TOTAL)


def labels(lang: str) -> dict[str, str]:
    rows = dimension_table("labels").to_pylist()
    return {r["key"]: r["label"] for r in rows if r["lang"] == lang}


def _totals(df: DataFrame, **rules: Column) -> DataFrame:
    """Row counts in one pass: the district by its member flag, the counties by name."""
    members = {TOTAL: F.col("lhd") == 1} | {c: F.col("county_name") == c for c in counties()}
    counts = [
        F.count_if(member & rule).alias(f"{i}_{name}")
        for i, member in enumerate(members.values())
        for name, rule in rules.items()
    ]
    rows = [
        F.struct(
            F.lit(region).alias("region"), *[F.col(f"{i}_{name}").alias(name) for name in rules]
        )
        for i, region in enumerate(members)
    ]
    return df.agg(*counts).select(F.inline(F.array(*rows)))


def _last(panel: DataFrame, date: str, **metrics: str) -> DataFrame:
    return panel.groupBy("region").agg(
        *[F.max_by(col, date).alias(name) for name, col in metrics.items()]
    )


def regional_scorecard(
    deaths: DataFrame,
    cases: DataFrame,
    weekly: DataFrame,
    daily: DataFrame,
    tests: DataFrame,
) -> DataFrame:
    """Totals of the cleaned extracts and the last value of the panels, one row per region."""
    return scorecard(
        [
            _totals(deaths, total_deaths=F.lit(True)),
            _totals(
                cases,
                total_hospitalizations=F.col("hosp") == "Yes",
                total_cases=F.lit(True),
            ),
            _last(weekly, "week_of", new_weekly_cases="weekly_cases"),
            _last(daily, "date", mean_7d="mean_7d"),
            _last(tests, "date", positivity_7d="positivity_7d"),
        ],
        order=REGION_ORDER,
    )


def dose_scorecard(coverage: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Doses given and whole percent of the population from age 5, as of the last panel day."""
    last = coverage.filter(F.col("date") == date_lit(as_of))

    def pick(dose: str, band: str, col: str) -> Column:
        chosen = (F.col("dose") == dose) & (F.col("band") == band)
        return F.max(F.when(chosen, F.col(col)))

    return (
        last.groupBy("region")
        .agg(
            pick("total", "all", "total").alias("total_doses"),
            int_trunc(pick("second", "5up", "percent")).alias("percent_complete_5up"),
            int_trunc(pick("first", "5up", "percent")).alias("percent_first_5up"),
        )
        .withColumn(
            "position", F.array_position(F.lit(list(REGION_ORDER)), F.col("region")).cast("int")
        )
    )


def labelled(df: DataFrame, lang: str) -> DataFrame:
    """The table under its display names in ``lang``."""
    return relabel(df, labels(lang))
