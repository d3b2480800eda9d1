"""Conditional expressions: ordered first match, with an explicit default."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import ColumnOrName, _col


def first_match(rules: Iterable[tuple[Column, object]], default: object = None) -> Column:
    """Value of the first rule that holds; a null predicate does not hold."""
    out = None
    for predicate, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(predicate, value) if out is None else out.when(predicate, value)
    default = default if isinstance(default, Column) else F.lit(default)
    return default if out is None else out.otherwise(default)


def bucketize(
    c: ColumnOrName, upper: Sequence[float], labels: Sequence[str], default: str = "Unknown"
) -> Column:
    """Label of the first band whose exclusive upper bound exceeds ``c``.

    Null, and values at or above the last bound, get ``default``.
    """
    if len(upper) != len(labels):
        raise ValueError("upper bounds and labels differ in length")
    return first_match([(_col(c) < u, label) for u, label in zip(upper, labels)], default)


def flag_any(*predicates: Column) -> Column:
    """1 if any predicate holds, else 0; null counts as not holding."""
    return first_match([(p, 1) for p in predicates], 0)


def yes_no_unknown(c: ColumnOrName, keep_null: bool = False) -> Column:
    """``Yes`` and ``No`` pass through, everything else reads ``Unknown``."""
    known = F.when(_col(c).isin("Yes", "No"), _col(c))
    if keep_null:
        return known.when(_col(c).isNull(), F.lit(None)).otherwise(F.lit("Unknown"))
    return known.otherwise(F.lit("Unknown"))


def override_if_in(c: ColumnOrName, values: Sequence, replacement: object) -> Column:
    return F.when(_col(c).isin(list(values)), F.lit(replacement)).otherwise(_col(c))


def dominant_category(c: ColumnOrName, dominant: str, fallback: ColumnOrName) -> Column:
    """``dominant`` where ``c`` says so, otherwise the fallback column as text.

    A missing ``c`` leaves the category missing, as an if/else on a missing test does.
    """
    return F.when(_col(c) == dominant, F.lit(dominant)).when(
        _col(c).isNotNull(), _col(fallback).cast("string")
    )
