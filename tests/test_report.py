"""Report tables."""

from __future__ import annotations

import datetime as dt

from tidewatch import operators as O

D = dt.date


def test_trailing_days_and_latest(spark, rows):
    df = spark.createDataFrame([(D(2021, 9, i), i) for i in range(1, 21)], "d date, n int")
    assert len(rows(O.trailing_days(df, "d", "2021-09-20", 13))) == 14
    assert rows(O.latest_rows(df, "d")) == [(D(2021, 9, 20), 20)]
    assert rows(O.latest_rows(df, "d", "2021-09-03")) == [(D(2021, 9, 3), 3)]
    flagged = O.flag_provisional(df, "d", "2021-09-20", 7)
    assert flagged.filter("provisional").count() == 8


def test_search_and_sort(spark, rows):
    df = spark.createDataFrame(
        [("Sky View High", 3), ("Ridgeline", 9), (None, 5)], "school string, n int"
    )
    assert rows(O.search_rows(df, "VIEW")) == [("Sky View High", 3)]
    assert rows(O.search_rows(df, "9")) == [("Ridgeline", 9)]
    assert [r.n for r in O.sort_desc(df, ["n"], limit=2).collect()] == [9, 5]


def test_scorecard_relabel(spark, rows):
    a = spark.createDataFrame([("Cache", 1), ("Rich", 2)], "region string, x int")
    b = spark.createDataFrame([("Cache", 0.5)], "region string, y double")
    card = O.scorecard([a, b], order=["Rich", "Cache"])
    assert rows(card) == [("Cache", 1, 0.5, 2), ("Rich", 2, None, 1)]
    assert O.relabel(card, {"x": "Total X"}).columns == ["region", "Total X", "y", "position"]


def test_chart_series_and_widen(spark, rows):
    wide = spark.createDataFrame([(D(2021, 1, 1), 1, 2.5)], "d date, a int, b double")
    assert rows(O.chart_series(wide, "d", {"a": "New", "b": "Mean"})) == [
        (D(2021, 1, 1), "Mean", 2.5),
        (D(2021, 1, 1), "New", 1.0),
    ]
    long = spark.createDataFrame(
        [(D(2021, 1, 1), "Rich", 4), (D(2021, 1, 1), "Cache", 6)], "d date, region string, n int"
    )
    out = O.widen(long, "d", "region", {"Rich": "rich", "Cache": "cache"}, ["n"])
    assert rows(out, "rich_n", "cache_n") == [(4, 6)]
