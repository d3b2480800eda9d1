"""Cumulative population coverage by region, dose and band."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import first_match, safe_ratio
from ..operators import cumulative, spine_counts
from ..operators.panel import TOTAL
from ..sources import dense_grid, dimension
from ..sources.dimensions import dimension_table

# First day of the panel, and the open-ended bands with their youngest age.
DOSES_START = dt.date(2020, 12, 17)
FROM_AGE = {"5up": 5, "12up": 12}
UNKNOWN_BANDS = ("unknown_age", "unknown_race")
DOSES = ("first", "second", "third")


def _band(kind: str, c: str) -> Column:
    rows = [r for r in dimension_table("coverage_band").to_pylist() if r["kind"] == kind]
    return first_match([(F.col(c) == r["value"], r["band"]) for r in rows])


def _each(df: DataFrame, members: list[Column], name: str) -> DataFrame:
    """One row per member that is not null.

    The array itself is never empty, so no size test on it is inferred and pushed down to the
    scan, where it would evaluate the attributes once more.
    """
    return df.withColumn(name, F.explode(F.array(*members))).filter(F.col(name).isNotNull())


def coverage_grid(population: DataFrame) -> DataFrame:
    """Combinations reported: every dose for each band with a population or an unknown band,
    plus all doses taken together. Boosters have no band from age 5."""
    regions = population.filter(F.col("band") == "all")
    known = population.select("region", "band", "population")
    unknown = regions.select(
        "region",
        F.explode(F.array(*[F.lit(b) for b in UNKNOWN_BANDS])).alias("band"),
        F.lit(None).cast("long").alias("population"),
    ).filter((F.col("region") == TOTAL) | (F.col("band") != "unknown_race"))
    per_dose = known.unionByName(unknown).select(
        "*", F.explode(F.array(*[F.lit(d) for d in DOSES])).alias("dose")
    )
    per_dose = per_dose.filter(~((F.col("dose") == "third") & (F.col("band") == "5up")))
    total = regions.select(
        "region", "band", F.lit(None).cast("long").alias("population"), F.lit("total").alias("dose")
    )
    return per_dose.unionByName(total)


def coverage_panel(
    doses: DataFrame,
    as_of: dt.date | str,
    home: str,
    start: dt.date = DOSES_START,
    population: DataFrame | None = None,
) -> DataFrame:
    """Doses and percent of population reached, running totals per day.

    One dose can count for a county and the district, for several dose classes, and for several
    overlapping bands. Doses are first counted once per combination of their attributes; only
    those counts are multiplied into every series they belong to.
    """
    population = population or dimension(doses.sparkSession, "coverage_population")
    attributes = doses.select(
        F.col("vaccine_date").alias("date"),
        F.when(F.col("district") == home, TOTAL).alias("total_region"),
        F.col("county"),
        F.when(F.col("dose_all") == 1, "first").alias("first"),
        F.when(F.col("vaccine_status") == "Complete", "second").alias("second"),
        F.when(F.col("booster_dose") == "Yes", "third").alias("third"),
        _band("age", "age").alias("age_band"),
        _band("race", "race_eth").alias("race_band"),
        *[
            F.when(F.col("age_original") >= age, band).alias(f"band_{band}")
            for band, age in FROM_AGE.items()
        ],
    )
    cube = attributes.groupBy(*attributes.columns).agg(F.count("*").alias("n"))
    members = _each(cube, [F.col("total_region"), F.col("county")], "region")
    members = _each(
        members, [F.col("first"), F.col("second"), F.col("third"), F.lit("total")], "dose"
    )
    bands = ["age_band", "race_band", *[f"band_{b}" for b in FROM_AGE]]
    members = _each(members, [F.lit("all"), *[F.col(b) for b in bands]], "band").filter(
        (F.col("dose") != "total") | (F.col("band") == "all")
    )
    on = ["date", "region", "dose", "band"]
    grid = dense_grid(coverage_grid(population), start, as_of)
    panel = spine_counts(members, grid, on, {"doses": F.col("n")})
    panel = cumulative(panel, {"doses": "total"}, "date", ["region", "dose", "band"])
    return panel.withColumn(
        "percent", safe_ratio("total", "population", scale=100, digits=2)
    ).select(*on, "doses", "total", "population", "percent")
