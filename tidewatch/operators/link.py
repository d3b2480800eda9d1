"""Record linkage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import Keys, _keys


# Joins compare ids wrapped in a struct. Spark then shuffles both sides for the join itself, even
# where one of them comes out of an aggregation on the same id, and adaptive execution can split
# the partitions of a hot id: it leaves a side alone whose shuffle serves something else as well.
_KEY = "_key"
_SIDES, _LEFT, _RIGHT = "_sides", 1, 2


def _complete(keys: Sequence[str]) -> Column:
    test = F.col(keys[0]).isNotNull()
    for k in keys[1:]:
        test = test & F.col(k).isNotNull()
    return test


def _keyed(df: DataFrame, keys: Sequence[str], null_safe: bool) -> tuple[DataFrame, DataFrame]:
    """Rows that can link, with their key, and rows that cannot because an id is missing."""
    linkable = F.lit(True) if null_safe else _complete(keys)
    return df.filter(linkable).withColumn(_KEY, F.struct(*keys)), df.filter(~linkable)


def anti_join(
    left: DataFrame, right: DataFrame, key: Keys, null_safe: bool = False
) -> DataFrame:
    """Rows of ``left`` whose key is absent from ``right``; a missing key is never found.

    Missing keys stay out of the shuffle, where they would all land in one task, and the right
    side is cut down to its distinct keys first.
    """
    keys = _keys(key)
    rows, incomplete = _keyed(left, keys, null_safe)
    found, _ = _keyed(right.select(*keys).distinct(), keys, null_safe)
    lone = rows.join(found.select(_KEY), _KEY, "left_anti").drop(_KEY)
    return lone.unionByName(incomplete)


def link_records(
    left: DataFrame,
    right: DataFrame,
    key: Keys,
    how: str = "full",
    null_safe: bool = False,
    right_unique: bool = False,
) -> DataFrame:
    """Join two record sets on an id, keeping what has no partner on either side.

    A full outer join cannot be split when one key is hot; an inner join can, on both sides. Ids
    that one side lacks are told by one aggregate over the ids of both, and that side is given an
    empty partner for each, so a single inner join keeps every row. If the right side has at most
    one row per key (``right_unique``), a left outer join, which can be split too, needs no ids.
    With ``null_safe`` a missing key links to a missing key.
    """
    keys = _keys(key)
    if how not in ("full", "left", "inner"):
        raise ValueError(f"unsupported linkage {how!r}")
    overlap = set(left.columns) & set(right.columns) - set(keys)
    if overlap:
        raise ValueError(f"rename the shared columns first: {sorted(overlap)}")
    rows, left_incomplete = _keyed(left, keys, null_safe)
    partners, right_incomplete = _keyed(right, keys, null_safe)
    if how == "left" and right_unique:
        out = rows.join(partners.drop(*keys), _KEY, "left").drop(_KEY)
        return out.unionByName(left_incomplete, allowMissingColumns=True)
    if how != "inner":
        rows, partners = _partnered(rows, partners, both=how == "full")
    out = rows.drop(*keys).join(partners.drop(*keys), _KEY).select(
        *[F.col(f"{_KEY}.`{k}`").alias(k) if k in keys else F.col(f"`{k}`") for k in left.columns],
        *[F.col(f"`{c}`") for c in right.columns if c not in keys],
    )
    if null_safe or how == "inner":
        return out
    out = out.unionByName(left_incomplete, allowMissingColumns=True)
    return out.unionByName(right_incomplete, allowMissingColumns=True) if how == "full" else out


def _lone(sides: DataFrame, side: int) -> DataFrame:
    """Keys that only one side has. Both questions read one and the same aggregate."""
    seen = sides.groupBy(_KEY).agg(F.bit_or(_SIDES).alias(_SIDES))
    return seen.filter(F.col(_SIDES) == side).select(_KEY)


def _partnered(left: DataFrame, right: DataFrame, both: bool = True) -> tuple[DataFrame, DataFrame]:
    """Both sides with a row of nulls for each key that only the other one has."""
    sides = left.select(_KEY, F.lit(_LEFT).alias(_SIDES)).unionByName(
        right.select(_KEY, F.lit(_RIGHT).alias(_SIDES))
    )
    more = right.unionByName(_lone(sides, _LEFT), allowMissingColumns=True)
    if both:
        left = left.unionByName(_lone(sides, _RIGHT), allowMissingColumns=True)
    return left, more


def natural_full_join(left: DataFrame, right: DataFrame, copies: str = "copies") -> DataFrame:
    """Full outer join on every column the two frames share; nulls equal nulls.

    Equal rows are counted per side first, each input being read once. Where a side has columns of
    its own, shared rows that the other side lacks are told from those counts and get an empty
    partner there, so one inner join, which can be split when a row is hot, does the rest: each
    distinct joined row comes out once, and ``copies`` says how often a join would repeat it (m*n for m equal left and n equal
    right rows, or the plain count where one side lacks it).
    """
    common = _shared(left, right)
    extras = [c for c in (*left.columns, *right.columns) if c not in common]
    if not extras:
        both = side_counts(left, right, common)
        return both.select(*common, (F.greatest("_m", F.lit(1)) * F.greatest("_n", F.lit(1))).alias(copies))
    a = left.groupBy(*left.columns).agg(F.count("*").alias("_m")).withColumn(_KEY, F.struct(*common))
    b = right.groupBy(*right.columns).agg(F.count("*").alias("_n")).withColumn(_KEY, F.struct(*common))
    # The counts take part, so that this reads the shuffle of the aggregates and not the inputs again.
    flag = lambda count, side: F.when(F.col(count) > 0, side).otherwise(0).alias(_SIDES)
    sides = a.select(_KEY, flag("_m", _LEFT)).unionByName(b.select(_KEY, flag("_n", _RIGHT)))
    left_lone, right_lone = _lone(sides, _LEFT), _lone(sides, _RIGHT)
    a = a.drop(*common).unionByName(right_lone, allowMissingColumns=True)
    b = b.drop(*common).unionByName(left_lone, allowMissingColumns=True)
    one = F.lit(1)
    return a.join(b, _KEY).select(
        *[F.col(f"{_KEY}.`{c}`").alias(c) if c in common else F.col(f"`{c}`") for c in left.columns],
        *[F.col(f"`{c}`") for c in right.columns if c not in common],
        (F.coalesce("_m", one) * F.coalesce("_n", one)).alias(copies),
    )


def _shared(left: DataFrame, right: DataFrame) -> list[str]:
    common = [c for c in left.columns if c in right.columns]
    if not common:
        raise ValueError("the frames share no column")
    return common


def side_counts(
    left: DataFrame,
    right: DataFrame,
    common: Sequence[str],
    extra_left: Sequence[str] = (),
    extra_right: Sequence[str] = (),
) -> DataFrame:
    """Each distinct shared row with ``_m`` copies on the left and ``_n`` on the right.

    The extra columns are those of the one copy; where there are several they mean nothing.
    """
    a = left.select(*common, *extra_left, F.lit(1).alias("_l"), F.lit(0).alias("_r"))
    b = right.select(*common, *extra_right, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    extras = [F.max(c).alias(c) for c in (*extra_left, *extra_right)]
    return (
        a.unionByName(b, allowMissingColumns=True)
        .groupBy(*common)
        .agg(F.sum("_l").alias("_m"), F.sum("_r").alias("_n"), *extras)
    )
