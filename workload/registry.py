"""Registered queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name together with its SQL."""

    def add(fn: Query) -> Query:
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key!r} is registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return add


def half_even_units(num: str, den: str, digits: int) -> str:
    """Integer SQL for ``num / den`` in units of the last digit kept, ties to even."""
    n = f"(CAST({num} AS HUGEINT) * {10 ** digits})"
    d = f"CAST({den} AS HUGEINT)"
    q, r = f"(abs({n}) // {d})", f"(abs({n}) % {d})"
    return (
        f"(CASE WHEN {d} = 0 THEN NULL ELSE CASE WHEN {n} < 0 THEN -1 ELSE 1 END * ({q} + "
        f"CASE WHEN 2 * {r} > {d} OR (2 * {r} = {d} AND {q} % 2 = 1) THEN 1 ELSE 0 END) END)"
    )


def half_even(num: str, den: str, digits: int) -> str:
    """Exact half-even rounding of a ratio of integers, as a double."""
    return f"(CAST({half_even_units(num, den, digits)} AS DOUBLE) / {10 ** digits})"


def full_window(agg: str, col: str, k: int, order: str, by: str = "") -> str:
    """Aggregate over the last ``k`` rows, null before there are ``k``."""
    part = f"PARTITION BY {by} " if by else ""
    w = f"OVER ({part}ORDER BY {order} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) {w} = {k} THEN {agg}({col}) {w} END"


def running(col: str, order: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return (
        f"CAST(sum({col}) OVER ({part}ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS BIGINT)"
    )


def spine_sql(start: str, end: str, step: str = "1 DAY", name: str = "date") -> str:
    return (
        f"SELECT CAST(unnest(generate_series(DATE '{start}', DATE '{end}', INTERVAL {step})) "
        f"AS DATE) AS {name}"
    )


SUNDAY = "CAST({0} - CAST(dayofweek({0}) AS INTEGER) AS DATE)"


def sunday(expr: str) -> str:
    return SUNDAY.format(f"CAST({expr} AS DATE)")
