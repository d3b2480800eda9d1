"""Gap-free date spines and entity-by-date grids."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import date_lit
from ..functions.dates import ColumnOrName, _col

STEPS = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month"}


def _dates(start: Column, end: Column, step: str) -> Column:
    # A spine whose end precedes its start is empty, not descending.
    ahead = F.when(start <= end, F.sequence(start, end, F.expr(STEPS[step])))
    return F.explode(ahead)


def date_spine(
    spark: SparkSession,
    start: dt.date | str,
    end: dt.date | str,
    step: str = "day",
    name: str = "date",
) -> DataFrame:
    """Every day, every seventh day or every month from ``start`` to ``end``, both included."""
    return spark.range(0, 1, 1, 1).select(_dates(date_lit(start), date_lit(end), step).alias(name))


def main_stretch(df: DataFrame, date: ColumnOrName, max_gap: int = 366) -> DataFrame:
    """``lo`` and ``hi`` of the stretch of dates that holds most rows of ``df``, one row.

    A stretch ends where no row falls for more than ``max_gap`` days, so a mistyped year stands apart
    however far off it is. Of stretches with as many rows the earliest counts; without dates both are
    null. Rows are counted per date first: what is ordered afterwards has a row per date.
    """
    day = _col(date).cast("date")
    in_order = Window.orderBy("_day")
    counts = df.filter(day.isNotNull()).groupBy(day.alias("_day")).agg(F.count("*").alias("_n"))
    gap = F.datediff("_day", F.lag("_day").over(in_order))
    stretches = (
        counts.withColumn("_cut", F.when(gap > max_gap, 1).otherwise(0))
        .withColumn("_stretch", F.sum("_cut").over(in_order))
        .groupBy("_stretch")
        .agg(F.sum("_n").alias("_n"), F.min("_day").alias("lo"), F.max("_day").alias("hi"))
    )
    best = F.max_by(F.struct("lo", "hi"), F.struct("_n", (-F.col("_stretch")).alias("_first")))
    return stretches.agg(best.alias("_best")).select("_best.lo", "_best.hi")


def off_stretch(df: DataFrame, date: ColumnOrName, max_gap: int = 366) -> DataFrame:
    """The rows of ``df`` dated outside its main stretch: what a spine cut there leaves out."""
    bounds = main_stretch(df, date, max_gap)
    day = _col(date).cast("date")
    lo, hi = (bounds.select(c).scalar() for c in ("lo", "hi"))
    return df.filter((day < lo) | (day > hi))


def spine_between(
    df: DataFrame,
    date: ColumnOrName,
    step: str = "day",
    name: str = "date",
    end: dt.date | str | None = None,
    max_gap: int | None = None,
) -> DataFrame:
    """Spine from the first to the last date found in ``df`` (or to a fixed ``end``).

    With ``max_gap`` it covers the main stretch alone; ``off_stretch`` has the rows left out.
    """
    if max_gap is None:
        bounds = df.agg(F.min(_col(date)).alias("lo"), F.max(_col(date)).alias("hi"))
    else:
        bounds = main_stretch(df, date, max_gap)
    stop = F.col("hi") if end is None else date_lit(end)
    return bounds.select(_dates(F.col("lo"), stop, step).alias(name))


def dense_grid(
    entities: DataFrame,
    start: dt.date | str,
    end: dt.date | str,
    step: str = "day",
    name: str = "date",
) -> DataFrame:
    """Each entity row repeated for every date: rows multiply in place, nothing is joined."""
    return entities.select(_dates(date_lit(start), date_lit(end), step).alias(name), "*")
