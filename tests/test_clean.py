"""Cleaning operators."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch import operators as O

D = dt.date


def test_fill_blank_leaves_numbers_alone(spark, rows):
    df = spark.createDataFrame([(None, None), ("a", 1)], "t string, n int")
    assert rows(O.fill_blank(df)) == [("", None), ("a", 1)]
    assert rows(O.fill_zero(df)) == [(None, 0), ("a", 1)]


def visits(spark):
    return spark.createDataFrame(
        [
            ("r1", "", 1),
            ("r1", "Inpatient", 2),
            ("r1", "Outpatient", 3),
            ("r2", "Outpatient", 1),
            ("r2", "Outpatient", 2),
            ("r3", "Unknown", 2),
            ("r3", "", 1),
            (None, "Outpatient", 1),
            (None, "Inpatient", 2),
        ],
        "id string, visit string, line int",
    )


def dedupe(df):
    order = ["Inpatient", "Outpatient", "Unknown"]
    return O.dedupe_by_priority(df, "id", "visit", order, ["line"])


def test_dedupe_by_priority(spark, rows):
    want = [
        (None, "Inpatient", 2),
        ("r1", "Inpatient", 2),
        ("r2", "Outpatient", 1),
        ("r3", "Unknown", 2),
    ]
    out = dedupe(visits(spark))
    assert rows(out) == want
    assert rows(dedupe(out)) == want


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_dedupe_does_not_depend_on_partitioning(spark, rows, partitions):
    df = spark.createDataFrame(
        [(i % 5, "x", i % 3, f"v{i}") for i in range(60)], "id int, visit string, a int, b string"
    )
    base = rows(O.dedupe_by_priority(df, "id", "visit", ["x"]))
    again = O.dedupe_by_priority(df.repartition(partitions, "b"), "id", "visit", ["x"])
    assert rows(again) == base


def test_unique_only(spark, rows):
    df = spark.createDataFrame(
        [("a", 1), ("b", 1), ("b", 2), (None, 1), (None, 2), ("c", 1)], "id string, v int"
    )
    assert rows(O.unique_only(df, "id")) == [("a", 1), ("c", 1)]
    alone = df.filter("id IS NULL AND v = 1")
    assert rows(O.unique_only(alone, "id")) == [(None, 1)]


def test_assert_unique(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "id string, v int")
    assert O.assert_unique(df, ["id", "v"]) is df
    with pytest.raises(ValueError, match="repeats"):
        O.assert_unique(df, "id")


def test_lookups(spark, rows):
    df = spark.createDataFrame([("a1",), ("b",), (None,)], "raw string")
    dim = spark.createDataFrame([("a1", "A")], "alias string, name string")
    assert rows(O.canonicalize(df, "raw", dim, "alias", "name", "school")) == [
        (None, None),
        ("a1", "A"),
        ("b", "b"),
    ]
    assert rows(O.map_codes(df, "raw", dim, "alias", "name", "label")) == [
        (None, None),
        ("a1", "A"),
        ("b", None),
    ]
    assert rows(O.map_codes(df, "raw", dim, "alias", "name", "label", "?")) == [
        (None, "?"),
        ("a1", "A"),
        ("b", "?"),
    ]
    assert rows(O.unmapped(df, "raw", dim, "alias")) == [("b", 1)]


def test_across(spark, rows):
    df = spark.createDataFrame([("x", 1, 2.0)], "k string, n int, Share_Per double")
    assert rows(O.across_numeric(df, lambda c: c * 2, exclude=["n"])) == [("x", 1, 4.0)]
    assert rows(O.across_matching(df, "per", lambda c: c + 1)) == [("x", 1, 3.0)]


def test_distinct_on_keeps_the_best(spark, rows):
    df = spark.createDataFrame([(1, 5), (1, 9), (2, 3)], "k int, v int")
    assert rows(O.distinct_on(df, "k", [F.desc("v")])) == [(1, 9), (2, 3)]


def test_nothing_to_fill(spark, rows):
    df = spark.createDataFrame([(1,), (None,)], "n int")
    assert rows(O.fill_blank(df)) == [(None,), (1,)]
    text = spark.createDataFrame([("a",), (None,)], "t string")
    assert rows(O.fill_zero(text)) == [(None,), ("a",)]
    assert rows(O.across_numeric(text, lambda c: c + 1)) == [(None,), ("a",)]


def test_parse_ints(spark, rows):
    df = spark.createDataFrame([("12",), ("12.0",), ("",), ("x",), (None,)], "t string")
    assert rows(O.parse_ints(df, ["t"])) == [(None,), (None,), (None,), (12,), (12,)]


def test_numbers_that_do_not_fit_are_null(spark, rows):
    text = ["12", "12.9", "-7.9", "1e12", "NaN", "4357525678", "", "x", None, "2147483647"]
    df = spark.createDataFrame([(t,) for t in text], "t string")
    got = O.parse_ints(df.withColumn("n", F.col("t")), ["n"])
    assert {r.t: r.n for r in got.collect()} == dict(
        zip(text, [12, 12, -7, None, None, None, None, None, None, 2147483647])
    )


def test_keep_first_tells_nulls_apart_from_values(spark):
    pair = [("k", D(2021, 1, 1), None), ("k", None, D(2021, 1, 1))]
    for order in (pair, pair[::-1]):
        df = spark.createDataFrame(order, "k string, a date, b date").repartition(2)
        assert [tuple(r) for r in O.distinct_on(df, "k").collect()] == [pair[1]]
