"""Column expressions, edge values first."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch import functions as X
from tidewatch.plans.extracts import AGE_LABELS, AGE_UPPER, age_band, city_rules

D = dt.date


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr.alias("o")).first().o


@pytest.mark.parametrize(
    "text, want",
    [
        ("2020-01-02", D(2020, 1, 2)),
        ("2020-01-02 10:00:00", D(2020, 1, 2)),
        ("", None),
        ("not a date", None),
        (None, None),
        ("2020-02-30", None),
    ],
)
def test_safe_date(spark, text, want):
    assert one(spark, text, "string", X.safe_date("v")) == want


@pytest.mark.parametrize(
    "day, sunday, monday",
    [
        (D(2021, 8, 21), D(2021, 8, 15), D(2021, 8, 16)),
        (D(2021, 8, 22), D(2021, 8, 22), D(2021, 8, 16)),
        (D(2021, 8, 23), D(2021, 8, 22), D(2021, 8, 23)),
    ],
)
def test_week_floor(spark, day, sunday, monday):
    assert one(spark, day, "date", X.week_floor("v")) == sunday
    assert one(spark, day, "date", X.week_floor("v", 1)) == monday


@pytest.mark.parametrize(
    "day, year, week",
    [
        (D(2019, 12, 29), 2020, 1),
        (D(2020, 12, 27), 2020, 53),
        (D(2021, 1, 2), 2020, 53),
        (D(2021, 1, 3), 2021, 1),
        (D(2022, 1, 1), 2021, 52),
        (D(2022, 1, 2), 2022, 1),
    ],
)
def test_epi_week(spark, day, year, week):
    assert one(spark, day, "date", X.epi_year("v")) == year
    assert one(spark, day, "date", X.epi_week("v")) == week


@pytest.mark.parametrize(
    "age, band",
    [(-1, "0-9"), (9, "0-9"), (10, "10-17"), (119, "86+"), (120, "Unknown"), (None, "Unknown")],
)
def test_age_band(spark, age, band):
    assert one(spark, age, "int", age_band("v")) == band


def test_age_bands_pair_up():
    assert len(AGE_UPPER) == len(AGE_LABELS)
    with pytest.raises(ValueError):
        X.bucketize("v", [1, 2], ["a"])


@pytest.mark.parametrize(
    "text, city",
    [
        ("NORTH LOGAN", "North Logan"),
        ("logan", "Logan"),
        ("Loagn", "Logan"),
        ("Logan", "Logan"),
        ("BRIGHAM CITY", "Brigham City"),
        ("Corrine", "Corinne"),
        ("Hyde Park", "Hyde Park"),
        ("hyrum", "hyrum"),
        ("", ""),
        (None, None),
    ],
)
def test_city_rules_first_match_case_sensitive(spark, text, city):
    assert one(spark, text, "string", X.normalize_text("v", city_rules())) == city


def test_regex_rules_still_work(spark):
    rules = [("^a.c$", "hit"), ("b|c", "plain")]
    assert one(spark, "abc", "string", X.normalize_text("v", rules)) == "hit"
    assert one(spark, "xbx", "string", X.normalize_text("v", rules)) == "plain"


@pytest.mark.parametrize(
    "value, digits, want",
    [
        (0.25, 1, 0.2),
        (0.75, 1, 0.8),
        (0.35000000000000003, 1, 0.4),
        (0.05000000000000001, 1, 0.0),
        (2.5, 0, 2.0),
        (-0.25, 1, -0.2),
        (None, 1, None),
    ],
)
def test_round_half_even(spark, value, digits, want):
    assert one(spark, value, "double", X.round_half_even("v", digits)) == want


def test_safe_ratio_and_rate(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 3), (None, 2), (5, None)], "a long, b long")
    got = df.select(
        X.safe_ratio("a", "b", digits=2).alias("r"), X.safe_ratio("a", "b", fill=0).alias("f")
    ).collect()
    assert [r.r for r in got] == [None, None, 0.33, None, None]
    assert [r.f for r in got] == [0.0, 0.0, 1 / 3, 0.0, 0.0]
    assert one(spark, 7, "long", X.rate("v", F.lit(2452))) == 285.48
    assert one(spark, 2.9, "double", X.int_trunc("v")) == 2
    assert one(spark, -2.9, "double", X.int_trunc("v")) == -2


@pytest.mark.parametrize(
    "value, plain, kept",
    [
        ("Yes", "Yes", "Yes"),
        ("No", "No", "No"),
        ("", "Unknown", "Unknown"),
        (None, "Unknown", None),
    ],
)
def test_yes_no_unknown(spark, value, plain, kept):
    assert one(spark, value, "string", X.yes_no_unknown("v")) == plain
    assert one(spark, value, "string", X.yes_no_unknown("v", keep_null=True)) == kept


def test_flags_overrides_and_categories(spark):
    assert one(spark, None, "string", X.flag_any(F.col("v") == "Yes")) == 0
    assert one(spark, "Yes", "string", X.flag_any(F.col("v") == "No", F.col("v") == "Yes")) == 1
    assert one(spark, 84323, "int", X.override_if_in("v", (84322, 84323), 84321)) == 84321
    assert one(spark, 84320, "int", X.override_if_in("v", (84322, 84323), 84321)) == 84320
    df = spark.createDataFrame(
        [("H", "White"), ("N", "White"), (None, "White")], "ethnicity string, race string"
    )
    got = df.select(X.dominant_category("ethnicity", "H", "race").alias("o")).collect()
    assert [r.o for r in got] == ["H", "White", None]


def test_blank_title_and_days(spark):
    for value, want in (("", True), (None, True), (" ", False), ("x", False)):
        assert one(spark, value, "string", X.is_blank("v")) is want
    assert one(spark, "A", "string", X.series_title("Cases at", "v")) == "Cases at A"
    assert one(spark, D(2021, 8, 20), "date", X.days_between("v", X.date_lit("2021-08-17"))) == 3
    assert one(spark, D(2021, 8, 20), "date", X.month_floor("v")) == D(2021, 8, 1)
