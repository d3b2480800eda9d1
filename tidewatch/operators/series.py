"""Time-series columns over panels.

Windows run over panel rows, per entity: a window partition holds one row per calendar date.
Never hand line-level rows to these.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import round_half_even, safe_ratio
from .clean import Keys, _keys, columns_of
from .panel import spine_counts


def _by(by: Keys | None, order: str) -> WindowSpec:
    return Window.partitionBy(*_keys(by or [])).orderBy(order)


def cumulative(
    df: DataFrame, cols: Mapping[str, str], order: str, by: Keys | None = None
) -> DataFrame:
    """Running totals: ``cols`` maps a column to the name of its total."""
    w = _by(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({new: F.sum(old).over(w) for old, new in cols.items()})


def cumulative_all(
    df: DataFrame, order: str, by: Keys | None = None, exclude: Sequence[str] = ()
) -> DataFrame:
    """Replace every numeric column by its running total."""
    skip = {order, *_keys(by or []), *exclude}
    cols = [c for c in columns_of(df, T.NumericType) if c not in skip]
    return cumulative(df, {c: c for c in cols}, order, by)


def trailing(
    agg: Column, col: str, k: int, order: str, by: Keys | None = None
) -> Column:
    """``agg`` over the last ``k`` rows, null until there are ``k`` of them."""
    w = _by(by, order).rowsBetween(1 - k, Window.currentRow)
    return F.when(F.count(col).over(w) == k, agg.over(w))


def trailing_mean(
    df: DataFrame,
    cols: Mapping[str, str],
    k: int,
    order: str,
    by: Keys | None = None,
    digits: int | None = 1,
    scale: float = 1,
) -> DataFrame:
    """Mean of the last ``k`` rows, times ``scale``, rounded half-even."""

    def mean(col: str) -> Column:
        out = trailing(F.avg(col), col, k, order, by)
        out = out * F.lit(scale) if scale != 1 else out
        return out if digits is None else round_half_even(out, digits)

    return df.withColumns({new: mean(old) for old, new in cols.items()})


def trailing_sum(
    df: DataFrame, cols: Mapping[str, str], k: int, order: str, by: Keys | None = None
) -> DataFrame:
    return df.withColumns(
        {new: trailing(F.sum(old), old, k, order, by) for old, new in cols.items()}
    )


def lag_ratio(
    df: DataFrame,
    col: str,
    k: int,
    order: str,
    by: Keys | None = None,
    ratio: str = "ratio",
    decrease: str = "decrease",
    digits: int = 2,
) -> DataFrame:
    """Value over its value ``k`` rows earlier, and the decrease ``1 - ratio``."""
    earlier = F.lag(col, k).over(_by(by, order))
    return df.withColumn(ratio, safe_ratio(col, earlier, digits=digits)).withColumn(
        decrease, 1 - F.col(ratio)
    )


def open_count(
    events: DataFrame,
    grid: DataFrame,
    start: str,
    k: int,
    by: Keys | None = None,
    date: str = "date",
    literal: bool = False,
) -> DataFrame:
    """Per grid row: intervals entered, entered so far, left so far and still open.

    An interval opens on ``start`` and closes ``k`` days later; no event is repeated for the
    days it stays open. An exit counts only if its entry is on the grid, so on a daily grid the
    exits are the entries of ``k`` rows before. ``literal`` counts every exit that falls on the
    grid instead, in which case the open number can drop below zero.
    """
    entity = _keys(by or [])
    entry = events.filter(F.col(start).isNotNull()).select(
        *entity, F.col(start).cast("date").alias(date)
    )
    if literal:
        ends = F.array(
            F.struct(F.col(date).alias("at"), F.lit(1).alias("entered"), F.lit(0).alias("left")),
            F.struct(
                F.date_add(date, k).alias("at"), F.lit(0).alias("entered"), F.lit(1).alias("left")
            ),
        )
        entry = entry.select(*entity, F.inline(ends)).withColumnRenamed("at", date)
        measures = {"entered": F.col("entered"), "left": F.col("left")}
    else:
        measures = {"entered": F.lit(1), "left": F.lit(0)}
    daily = spine_counts(entry, grid, [date, *entity], measures)
    return close_open(daily, [Interval(k)], date, entity, literal)


@dataclass(frozen=True)
class Interval:
    """Length of an interval and the columns its counts go by."""

    k: int
    entered: str = "entered"
    left: str = "left"
    entered_total: str = "entered_total"
    left_total: str = "left_total"
    open: str = "open"


def close_open(
    daily: DataFrame,
    intervals: Sequence[Interval],
    date: str,
    by: Keys | None = None,
    literal: bool = False,
) -> DataFrame:
    """Running totals of entries and exits of a gap-free daily panel, and their difference.

    Unless ``literal``, exits are the entries of ``k`` rows before, so both legs stem from the
    same events. All intervals share their window passes.
    """
    out = cumulative(daily, {i.entered: i.entered_total for i in intervals}, date, by)
    if literal:
        out = cumulative(out, {i.left: i.left_total for i in intervals}, date, by)
    else:
        w = _by(by, date)
        out = out.withColumns(
            {i.left_total: F.lag(i.entered_total, i.k, 0).over(w) for i in intervals}
        )
    return out.drop(*[i.left for i in intervals]).withColumns(
        {i.open: F.col(i.entered_total) - F.col(i.left_total) for i in intervals}
    )


def latest(df: DataFrame, date: str, cols: Sequence[str], by: Keys | None = None) -> DataFrame:
    """Value of each column on the last date, per entity."""
    return df.groupBy(*_keys(by or [])).agg(*[F.max_by(c, date).alias(c) for c in cols])
