"""Spines, panels and time-series columns."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewatch import operators as O
from tidewatch.functions import round_half_even
from tidewatch.sources import date_spine, dense_grid, main_stretch, off_stretch, spine_between

D = dt.date
START, END = D(2021, 8, 18), D(2021, 9, 6)
DAYS = [START + dt.timedelta(days=i) for i in range((END - START).days + 1)]


def events(spark, n=200, seed=1):
    rnd = random.Random(seed)
    span = [START - dt.timedelta(days=15) + dt.timedelta(days=i) for i in range(50)]
    data = [
        (rnd.choice(span + [None]), rnd.choice(["a", "a", "a", "b", "zz", None]), rnd.random() < 0.4)
        for _ in range(n)
    ]
    return data, spark.createDataFrame(data, "date date, entity string, hit boolean")


def test_spines(spark, rows):
    assert rows(date_spine(spark, START, END)) == [(d,) for d in DAYS]
    weeks = rows(date_spine(spark, D(2020, 3, 29), D(2020, 4, 18), "week", "week_of"))
    assert weeks == [(D(2020, 3, 29),), (D(2020, 4, 5),), (D(2020, 4, 12),)]
    months = rows(date_spine(spark, D(2020, 11, 1), D(2021, 2, 1), "month"))
    assert [d.month for (d,) in months] == [11, 12, 1, 2]
    assert rows(date_spine(spark, END, START)) == []
    df = spark.createDataFrame([(D(2021, 1, 3),), (D(2021, 1, 1),), (None,)], "d date")
    assert len(rows(spine_between(df, "d"))) == 3
    assert len(rows(spine_between(df, "d", end=D(2021, 1, 5)))) == 5


def test_grid_covers_every_entity(spark):
    schools = spark.createDataFrame([("a", 1), ("b", None)], "entity string, size int")
    grid = dense_grid(schools, START, END)
    assert grid.count() == 2 * len(DAYS)
    assert grid.columns == ["date", "entity", "size"]


def test_spine_counts_equal_fill_spine_and_drop_the_rest(spark, rows):
    data, df = events(spark)
    entities = spark.createDataFrame([("a",), ("b",), ("c",)], "entity string")
    grid = dense_grid(entities, START, END)
    got = O.spine_counts(
        df, grid, ["date", "entity"], {"n": F.lit(1), "hits": F.col("hit")}
    )
    joined = O.fill_spine(
        grid,
        O.count_where(df, ["date", "entity"], n=F.lit(True), hits=F.col("hit")),
        ["date", "entity"],
    )
    cols = ("date", "entity", "n", "hits")
    assert rows(got, *cols) == rows(joined, *cols)
    want = sorted(
        (d, e, sum(x == d and y == e for x, y, _ in data),
         sum(x == d and y == e and h for x, y, h in data))
        for d in DAYS for e in "abc"
    )
    assert rows(got, *cols) == want
    kept = sum(r[2] for r in want)
    audit = O.dropped_events(df, grid, ["date", "entity"])
    assert audit.agg(F.sum("dropped")).first()[0] == len(data) - kept


def test_fill_gaps(spark, rows):
    df = spark.createDataFrame(
        [("a", D(2021, 1, 1), 3), ("a", D(2021, 1, 4), 2), ("b", D(2021, 1, 2), 1)],
        "k string, d date, n long",
    )
    assert rows(O.fill_gaps(df, "d", "day", "k"), "k", "d", "n") == [
        ("a", D(2021, 1, 1), 3),
        ("a", D(2021, 1, 2), 0),
        ("a", D(2021, 1, 3), 0),
        ("a", D(2021, 1, 4), 2),
        ("b", D(2021, 1, 2), 1),
    ]
    months = spark.createDataFrame([(D(2020, 11, 1), 1), (D(2021, 2, 1), 1)], "d date, n long")
    assert [r.n for r in O.fill_gaps(months, "d", "month").orderBy("d").collect()] == [1, 0, 0, 1]


def test_mistyped_years_stand_apart(spark, rows):
    days = [D(2021, 1, 1), D(2021, 1, 3), D(2021, 1, 3), D(9999, 12, 31), D(1921, 1, 1), None]
    df = spark.createDataFrame(list(enumerate(days)), "id long, d date")
    assert rows(main_stretch(df, "d")) == [(D(2021, 1, 1), D(2021, 1, 3))]
    assert len(rows(spine_between(df, "d", max_gap=30))) == 3
    assert [r.id for r in off_stretch(df, "d").orderBy("id").collect()] == [3, 4]
    # As many rows in both: the earlier; a gap of just as many days is none.
    even = spark.createDataFrame([(D(2021, 1, 1),), (D(2021, 1, 31),), (D(2030, 1, 1),)], "d date")
    assert rows(main_stretch(even, "d", 30)) == [(D(2021, 1, 1), D(2021, 1, 31))]
    assert rows(main_stretch(even, "d", 29)) == [(D(2021, 1, 1), D(2021, 1, 1))]
    nothing = df.filter("d is null")
    assert rows(main_stretch(nothing, "d")) == [(None, None)]
    assert rows(spine_between(nothing, "d", max_gap=30)) == rows(off_stretch(nothing, "d")) == []
    counts = df.filter("d is not null").groupBy("d").agg(F.count("*").alias("n"))
    got = rows(O.fill_gaps(counts, "d", "day", max_gap=30), "d", "n")
    assert got == [
        (D(1921, 1, 1), 1),
        (D(2021, 1, 1), 1),
        (D(2021, 1, 2), 0),
        (D(2021, 1, 3), 2),
        (D(9999, 12, 31), 1),
    ]


def test_region_rules_need_not_add_up(spark):
    df = spark.createDataFrame(
        [(START, "Cache", "Confirmed"), (START, "Cache", "Probable"), (START, None, "Confirmed")],
        "date date, county string, status string",
    )
    panel = O.region_spine_counts(
        df,
        date_spine(spark, START, START + dt.timedelta(days=1)),
        "date",
        {"All": F.lit(True), "Cache": F.col("county") == "Cache"},
        {"n": F.lit(True), "probable": F.col("status") == "Probable"},
        {("All", "n"): F.col("status") == "Confirmed"},
    )
    got = {(r.date, r.region): (r.n, r.probable) for r in panel.collect()}
    later = START + dt.timedelta(days=1)
    assert got == {
        (START, "All"): (2, 1),
        (START, "Cache"): (2, 1),
        (later, "All"): (0, 0),
        (later, "Cache"): (0, 0),
    }


def test_region_names_may_hold_quotes(spark):
    df = spark.createDataFrame([(START, 1)], "date date, n int")
    panel = O.region_spine_counts(
        df, date_spine(spark, START, START), "date", {"O'Brien \\ Co": F.lit(True)}, {"n": F.lit(True)}
    )
    assert [tuple(r) for r in panel.collect()] == [(START, "O'Brien \\ Co", 1)]


def test_disjoint_bands_add_up(spark):
    data, df = events(spark, 120, seed=5)
    spine = date_spine(spark, START, END)
    bands = {"yes": F.col("hit"), "no": ~F.col("hit"), "all": F.lit(True)}
    panel = O.cumulative(O.spine_counts(df, spine, "date", bands), {"all": "total"}, "date")
    got = panel.orderBy("date").collect()
    assert all(r.yes + r.no == r["all"] for r in got)
    assert got[-1].total == sum(r["all"] for r in got)
    assert got[-1].total == sum(d is not None and START <= d <= END for d, _, _ in data)


def series(spark, values):
    data = [("e", START + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "entity string, date date, n long")


@pytest.mark.parametrize("length", [3, 4, 9])
def test_trailing_windows_wait_for_k_rows(spark, length):
    values = [(7 * i) % 5 for i in range(length)]
    df = series(spark, values)
    df = O.trailing_mean(df, {"n": "m"}, 4, "date", "entity", digits=None)
    df = O.trailing_sum(df, {"n": "s"}, 4, "date", "entity")
    df = O.cumulative(df, {"n": "t"}, "date", "entity")
    got = df.orderBy("date").collect()
    for i, r in enumerate(got):
        window = values[i - 3 : i + 1] if i >= 3 else None
        assert r.s == (sum(window) if window else None)
        assert r.m == (sum(window) / 4 if window else None)
        assert r.t == sum(values[: i + 1])


def test_means_round_ties_to_even(spark):
    df = O.trailing_mean(series(spark, [0, 0, 0, 1]), {"n": "m"}, 4, "date", "entity")
    assert df.orderBy(F.desc("date")).first().m == 0.2
    df = O.trailing_mean(series(spark, [1, 1, 1, 0]), {"n": "m"}, 4, "date", "entity")
    assert df.orderBy(F.desc("date")).first().m == 0.8


def test_lag_ratio(spark):
    df = O.lag_ratio(series(spark, [2, 0, 3, 4]), "n", 2, "date", "entity")
    got = df.orderBy("date").collect()
    assert [r.ratio for r in got] == [None, None, 1.5, None]
    assert [r.decrease for r in got] == [None, None, -0.5, None]


@pytest.mark.parametrize("k", [7, 10])
def test_open_count_against_brute_force(spark, k):
    data, df = events(spark, 300, seed=k)
    entities = spark.createDataFrame([("a",), ("b",), ("c",)], "entity string")
    grid = dense_grid(entities, START, END)
    span = dt.timedelta(days=k)
    for literal in (False, True):
        got = O.open_count(df, grid, "date", k, "entity", literal=literal).collect()
        assert len(got) == 3 * len(DAYS)
        for r in got:
            mine = [d for d, e, _ in data if e == r.entity and d is not None]
            entered = [d for d in mine if START <= d <= r.date]
            left = [d for d in (mine if literal else entered) if START <= d + span <= r.date]
            assert r.entered_total == len(entered)
            assert r.left_total == len(left)
            assert r.open == len(entered) - len(left)
            if not literal:
                assert r.open == sum(r.date - span < d <= r.date for d in entered)


def test_literal_open_count_can_fall_below_zero(spark):
    early = spark.createDataFrame([(START - dt.timedelta(days=3),)], "date date")
    spine = date_spine(spark, START, END)
    literal = O.open_count(early, spine, "date", 10, literal=True)
    assert literal.agg(F.min("open")).first()[0] == -1
    assert O.open_count(early, spine, "date", 10).agg(F.min("open")).first()[0] == 0


def test_cumulative_all_latest_and_totals(spark, rows):
    df = spark.createDataFrame(
        [("a", D(2021, 1, 1), 1, 2.0), ("a", D(2021, 1, 2), 3, 4.0), ("b", D(2021, 1, 1), 5, 6.0)],
        "k string, d date, n int, x double",
    )
    assert rows(O.cumulative_all(df, "d", "k")) == [
        ("a", D(2021, 1, 1), 1, 2.0),
        ("a", D(2021, 1, 2), 4, 6.0),
        ("b", D(2021, 1, 1), 5, 6.0),
    ]
    assert rows(O.latest(df, "d", ["n"], "k")) == [("a", 3), ("b", 5)]
    total = O.with_total(df, "d", "k", "ALL", n=F.col("n"))
    assert rows(total, "d", "k", "n") == [
        (D(2021, 1, 1), "ALL", 6),
        (D(2021, 1, 1), "a", 1),
        (D(2021, 1, 1), "b", 5),
        (D(2021, 1, 2), "ALL", 3),
        (D(2021, 1, 2), "a", 3),
    ]
    assert rows(O.freq(spark.createDataFrame([("x",), ("x",), (None,)], "v string"), "v")) == [
        ("x", 2)
    ]
    assert rows(O.pivot_counts(df, "d", "k", ["a", "c"])) == [
        (D(2021, 1, 1), 1, 0),
        (D(2021, 1, 2), 1, 0),
    ]


def test_rounded_mean_of_rates_matches_exact_arithmetic(spark):
    """Ties among means of two-digit decimals, which binary sums blur."""
    from decimal import ROUND_HALF_EVEN, Decimal

    rnd = random.Random(3)
    data = [tuple(rnd.randrange(0, 2000, 5) for _ in range(7)) for _ in range(400)]
    df = spark.createDataFrame(
        [([c / 100 for c in cents],) for cents in data], "v array<double>"
    )
    total = F.aggregate("v", F.lit(0.0), lambda a, b: a + b)
    got = [r[0] for r in df.select(round_half_even(total / 7, 1)).collect()]
    want = [
        float((Decimal(sum(c)) / 700).quantize(Decimal("0.1"), ROUND_HALF_EVEN)) for c in data
    ]
    assert got == want
