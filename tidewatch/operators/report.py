"""Report tables: scorecards, labels, chart series, searches and line-list filters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_date, date_lit
from .clean import Keys, _keys


def trailing_days(df: DataFrame, date: str, as_of: dt.date | str, k: int) -> DataFrame:
    """Rows dated ``as_of - k`` or later; the bound is a literal, so the scan can use it."""
    return df.filter(F.col(date) >= date_lit(as_date(as_of) - dt.timedelta(days=k)))


def latest_rows(df: DataFrame, date: str, latest: dt.date | str | None = None) -> DataFrame:
    """Rows at the newest date.

    Pass ``latest`` when it is known (a panel ends at its run date): that saves computing the
    maximum first.
    """
    newest = date_lit(latest) if latest is not None else df.agg(F.max(date)).scalar()
    return df.filter(F.col(date) == newest)


def search_rows(df: DataFrame, term: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows with ``term`` anywhere in their text, ignoring case."""
    text = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in cols or df.columns]))
    return df.filter(text.contains(term.lower()))


def sort_desc(df: DataFrame, cols: Sequence[str], limit: int | None = None) -> DataFrame:
    """Largest first; with ``limit``, Spark keeps the top rows per task and merges those."""
    out = df.orderBy(*[F.desc(c) for c in cols])
    return out if limit is None else out.limit(limit)


def flag_provisional(
    df: DataFrame, date: str, as_of: dt.date | str, k: int, name: str = "provisional"
) -> DataFrame:
    """Mark the last ``k`` days, whose events may not have been reported yet."""
    return df.withColumn(name, F.col(date) >= date_lit(as_date(as_of) - dt.timedelta(days=k)))


def scorecard(
    parts: Sequence[DataFrame], key: str = "region", order: Sequence[str] | None = None
) -> DataFrame:
    """One row per region from several per-region tables.

    The parts are stacked and regrouped rather than joined one by one; each metric must come
    from one part only. ``order`` adds a position column.
    """
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    metrics = [c for c in out.columns if c != key]
    out = out.groupBy(key).agg(*[F.max(c).alias(c) for c in metrics])
    if order is not None:
        out = out.withColumn(
            "position", F.array_position(F.lit(list(order)), F.col(key)).cast("int")
        )
    return out


def relabel(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Display names for columns; columns without one keep theirs."""
    return df.withColumnsRenamed({c: labels[c] for c in df.columns if c in labels})


def chart_series(
    df: DataFrame, ids: Keys, cols: Mapping[str, str] | Sequence[str]
) -> DataFrame:
    """Wide to long, one row per id and series; ``cols`` may map columns to series names."""
    names = dict(cols) if isinstance(cols, Mapping) else {c: c for c in cols}
    ids = _keys(ids)
    values: list[Column] = [F.col(f"`{c}`").cast("double").alias(n) for c, n in names.items()]
    return df.select(*ids, *values).unpivot(ids, list(names.values()), "series", "value")


def widen(
    panel: DataFrame, keys: Keys, region: str, names: Mapping[str, str], metrics: Sequence[str]
) -> DataFrame:
    """Long panel to one row per date, columns ``<region>_<metric>`` for the listed regions."""
    picks = [
        F.max(F.when(F.col(region) == value, F.col(metric))).alias(f"{short}_{metric}")
        for value, short in names.items()
        for metric in metrics
    ]
    return panel.groupBy(*_keys(keys)).agg(*picks)
