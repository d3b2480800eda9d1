"""Counts on gap-free spines.

Counting comes first and is always a partial aggregate, so what is shuffled is one row per task
and group, however the events are spread over dates and regions. Everything after that works on
panel rows, whose number is bounded by the calendar and the entities listed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.spine import STEPS
from .clean import Keys, _keys, fill_zero

TOTAL = "District"


def count_where(df: DataFrame, keys: Keys, **predicates: Column) -> DataFrame:
    """Per group, how many rows satisfy each predicate; null does not satisfy."""
    counts = [F.count_if(p).alias(name) for name, p in predicates.items()]
    return df.groupBy(*_keys(keys)).agg(*counts)


def pivot_counts(df: DataFrame, keys: Keys, category: str, values: Sequence[str]) -> DataFrame:
    """Row counts per group, one column per listed value of ``category``; gaps are 0."""
    out = df.groupBy(*_keys(keys)).pivot(category, list(values)).count()
    return fill_zero(out, [str(v) for v in values])


def freq(df: DataFrame, col: str) -> DataFrame:
    """Frequency table without nulls."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))


def with_total(df: DataFrame, keys: Keys, region: str, total: str, **sums: Column) -> DataFrame:
    """Sums per region together with the sum over all regions, in one aggregation.

    Use it where the total is the sum of its parts; otherwise see ``region_spine_counts``.
    """
    keys = _keys(keys)
    by = [F.col(k) for k in keys]
    grouped = df.groupingSets([[*by, F.col(region)], by], *by, F.col(region))
    named = F.when(F.grouping(region) == 1, F.lit(total)).otherwise(F.col(region))
    return grouped.agg(
        named.alias("_region"), *[F.sum(c).alias(name) for name, c in sums.items()]
    ).drop(region).withColumnRenamed("_region", region)


def fill_spine(
    spine: DataFrame, counts: DataFrame, on: Keys, zero_cols: Sequence[str] | None = None
) -> DataFrame:
    """Every spine row with its counts, 0 where there are none; counts off the spine drop out."""
    keys = _keys(on)
    cols = list(zero_cols or [c for c in counts.columns if c not in keys])
    return fill_zero(spine.join(counts, keys, "left"), cols)


def fill_gaps(
    counts: DataFrame, date: str, step: str, by: Keys | None = None, max_gap: int | None = None
) -> DataFrame:
    """Add the dates missing between the first and the last row of each entity, counting 0.

    For spines whose bounds come from the data: each row reaches up to its successor, so the
    counts are computed once and no spine has to be built from them first. A gap of more than
    ``max_gap`` days stays open, so a mistyped date keeps its row and adds no others.
    """
    others = [c for c in counts.columns if c not in {date, *_keys(by or [])}]
    successor = F.lead(date).over(Window.partitionBy(*_keys(by or [])).orderBy(date))
    if max_gap is not None:
        near = F.datediff(successor, F.col(date)) <= max_gap
        successor = F.when(near, successor)
    days = F.sequence(F.col(date), F.coalesce("_next", F.col(date)), F.expr(STEPS[step]))
    # The successor is a row of its own.
    reach = F.when(F.col("_next").isNull(), days).otherwise(F.slice(days, 1, F.size(days) - 1))
    return (
        counts.withColumn("_next", successor)
        .select(*_keys(by or []), F.col(date).alias("_own"), *others, F.explode(reach).alias(date))
        .select(
            date,
            *_keys(by or []),
            *[F.when(F.col(date) == F.col("_own"), F.col(c)).otherwise(0).alias(c) for c in others],
        )
    )


def spine_counts(
    events: DataFrame, spine: DataFrame, on: Keys, measures: Mapping[str, Column]
) -> DataFrame:
    """Counts (or sums) per spine row; gaps are 0, events outside the spine drop out.

    A measure is a predicate to count or a whole number to add up. The events are aggregated
    before they meet the spine, so only counts take part in the join, and Spark broadcasts those
    if they turn out small.
    """
    keys = _keys(on)
    rows = events.select(*keys, *[m.alias(n) for n, m in measures.items()])
    totals = [
        f"count_if(`{n}`) AS `{n}`"
        if isinstance(rows.schema[n].dataType, T.BooleanType)
        else f"CAST(sum(`{n}`) AS BIGINT) AS `{n}`"
        for n in measures
    ]
    return fill_spine(spine, rows.groupBy(*keys).agg(*map(F.expr, totals)), keys)


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def region_spine_counts(
    events: DataFrame,
    spine: DataFrame,
    date: str,
    regions: Mapping[str, Column],
    measures: Mapping[str, Column],
    overrides: Mapping[tuple[str, str], Column] | None = None,
) -> DataFrame:
    """Long panel ``(date, region, measure...)``.

    A region is a membership predicate, so one row may count for several of them, and a total
    need not be the sum of its parts; ``overrides`` gives a region its own rule for a measure.
    All regions are counted side by side in one pass and turned into rows afterwards.
    """
    overrides = overrides or {}
    flags = events.select(
        date,
        *[c.alias(f"_r{i}") for i, c in enumerate(regions.values())],
        *[c.alias(f"_m{j}") for j, c in enumerate(measures.values())],
        *[c.alias(f"_o{k}") for k, c in enumerate(overrides.values())],
    )
    place = {pair: f"_o{k}" for k, pair in enumerate(overrides)}
    cells = {
        f"_c{i}_{j}": place.get((region, name), f"_r{i} AND _m{j}")
        for i, region in enumerate(regions)
        for j, name in enumerate(measures)
    }
    totals = [F.expr(f"count_if({rule}) AS {cell}") for cell, rule in cells.items()]
    wide = fill_spine(spine, flags.groupBy(date).agg(*totals), date)
    structs = [
        f"struct({_literal(region)} AS region, "
        + ", ".join(f"_c{i}_{j} AS `{name}`" for j, name in enumerate(measures))
        + ")"
        for i, region in enumerate(regions)
    ]
    return wide.selectExpr(date, f"inline(array({', '.join(structs)}))")


def dropped_events(events: DataFrame, spine: DataFrame, on: Keys) -> DataFrame:
    """Audit: event counts of the groups, null ones included, that lie outside the spine."""
    keys = _keys(on)
    counts = events.groupBy(*keys).agg(F.count("*").alias("dropped"))
    return counts.join(spine.select(*keys).distinct(), keys, "left_anti")


def with_population(
    panel: DataFrame, population: DataFrame, on: Keys, value: str = "population"
) -> DataFrame:
    """Attach a denominator; rows without one keep a null."""
    keys = _keys(on)
    return panel.join(population.select(*keys, value), keys, "left")
