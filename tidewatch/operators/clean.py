"""Cleaning, canonical values and keep-first rules."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import first_match, int_trunc, safe_date

Keys = str | Sequence[str]


def _keys(key: Keys) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def parse_dates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: safe_date(c) for c in cols})


def parse_ints(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Whole numbers from text such as ``12`` or ``12.0``; anything else becomes null.

    Anything else is text that is no number, NaN, and numbers beyond 32 bits.
    """
    return df.withColumns({c: int_trunc(F.col(c).try_cast("double")) for c in cols})


def columns_of(df: DataFrame, kind: type[T.DataType]) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kind)]


def fill_blank(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null text becomes the empty string; numbers and dates keep their nulls."""
    return df.na.fill("", subset=list(cols or columns_of(df, T.StringType)))


def fill_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.na.fill(0, subset=list(cols or columns_of(df, T.NumericType)))


def across_numeric(
    df: DataFrame, fn: Callable[[Column], Column], exclude: Sequence[str] = ()
) -> DataFrame:
    cols = [c for c in columns_of(df, T.NumericType) if c not in exclude]
    return df.withColumns({c: fn(F.col(f"`{c}`")) for c in cols})


def across_matching(df: DataFrame, pattern: str, fn: Callable[[Column], Column]) -> DataFrame:
    """Apply ``fn`` to the columns whose name matches ``pattern``, ignoring case."""
    cols = [c for c in df.columns if re.search(pattern, c, re.IGNORECASE)]
    return df.withColumns({c: fn(F.col(f"`{c}`")) for c in cols})


def _total_order(df: DataFrame) -> list[Column]:
    """An order that depends on row content only, so a repartitioning cannot change it.

    Rows that tie are equal in every column.
    """
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        plain = isinstance(f.dataType, (T.AtomicType, T.StructType, T.ArrayType))
        out.append((col if plain else F.to_json(col)).asc_nulls_first())
    return out


def _first_per_key(df: DataFrame, key: Keys, order: Sequence[Column]) -> DataFrame:
    # A row_number filter is applied once before the shuffle as well (window group limit), so a
    # key that holds much of the table still sends one row per task.
    w = Window.partitionBy(*_keys(key)).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def dedupe_by_priority(
    df: DataFrame,
    key: Keys,
    col: str,
    order: Sequence[str],
    tiebreak: Sequence[Column | str] = (),
) -> DataFrame:
    """One row per key, preferring the values of ``col`` in the given order; others come last.

    Ties go to ``tiebreak``, which should leave none (for instance ``input_order``). Without it
    row content decides, for which every column has to be read.
    """
    priority = first_match([(F.col(col) == v, i) for i, v in enumerate(order)], len(order))
    tie = [F.col(t) if isinstance(t, str) else t for t in tiebreak]
    return _first_per_key(df, key, [priority, *(tie or _total_order(df))])


def distinct_on(df: DataFrame, key: Keys, order: Sequence[Column | str] = ()) -> DataFrame:
    """One row per key: the first under ``order``, or by row content if none is given."""
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    return _first_per_key(df, key, by or _total_order(df))


def unique_only(df: DataFrame, key: Keys) -> DataFrame:
    """Rows whose key occurs exactly once; null keys count as equal to each other."""
    keys = _keys(key)
    # Two rows are enough to know a key repeats, and the limit holds before the shuffle.
    seen = Window.partitionBy(*keys).orderBy(*keys)
    return (
        df.withColumn("_seen", F.row_number().over(seen))
        .filter("_seen <= 2")
        .withColumn("_n", F.max("_seen").over(Window.partitionBy(*keys)))
        .filter("_n = 1")
        .drop("_seen", "_n")
    )


def assert_unique(df: DataFrame, key: Keys) -> DataFrame:
    """Return ``df``, or raise if a key repeats. Runs a job."""
    keys = _keys(key)
    repeated = df.groupBy(*keys).count().filter("count > 1").limit(5).collect()
    if repeated:
        raise ValueError(f"key {keys} repeats, for instance {[r.asDict() for r in repeated]}")
    return df


def _lookup(df: DataFrame, col: str, dim: DataFrame, key: str, value: str, name: str) -> DataFrame:
    # The dimension lists each key once (see assert_unique). No broadcast hint: Spark broadcasts
    # a dimension whose size it knows to be small, and shuffles a large one.
    side = dim.select(F.col(key).alias("_key"), F.col(value).alias(name))
    return df.join(side, F.col(f"`{col}`") == F.col("_key"), "left").drop("_key")


def canonicalize(
    df: DataFrame, col: str, dim: DataFrame, key: str, value: str, name: str
) -> DataFrame:
    """Canonical name of an alias, or the text itself when the dimension does not list it."""
    return _lookup(df, col, dim, key, value, "_canonical").withColumn(
        name, F.coalesce("_canonical", F.col(f"`{col}`").cast("string"))
    ).drop("_canonical")


def map_codes(
    df: DataFrame,
    col: str,
    dim: DataFrame,
    key: str,
    value: str,
    name: str,
    default: str | None = None,
) -> DataFrame:
    """Label of a code; null, or ``default``, for an unlisted one."""
    out = _lookup(df, col, dim, key, value, name)
    return out if default is None else out.na.fill(default, subset=[name])


def unmapped(df: DataFrame, col: str, dim: DataFrame, key: str) -> DataFrame:
    """Values of ``col`` the dimension does not list, with their row counts."""
    return (
        df.filter(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count("*").alias("rows"))
        .join(dim.select(F.col(key).alias(col)), col, "left_anti")
    )
