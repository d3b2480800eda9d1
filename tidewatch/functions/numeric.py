"""Rounding and ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import ColumnOrName, _col

# Digits kept beyond the requested ones before the tie is judged: a mean of decimals such as
# 0.05000000000000001 is a tie that binary arithmetic has blurred.
_GUARD_DIGITS = 8


def round_half_even(c: ColumnOrName, digits: int = 0) -> Column:
    """Round ties to the even digit, judging ties on the decimal value."""
    return F.bround(F.bround(_col(c).cast("double"), digits + _GUARD_DIGITS), digits)


def safe_ratio(
    num: ColumnOrName,
    den: ColumnOrName,
    scale: float = 1,
    digits: int | None = None,
    fill: float | None = None,
) -> Column:
    """``num * scale / den``; null (or ``fill``) where the denominator is zero or missing."""
    num = _col(num) * F.lit(scale) if scale != 1 else _col(num)
    out = F.try_divide(num.cast("double"), _col(den).cast("double"))
    if digits is not None:
        out = round_half_even(out, digits)
    return out if fill is None else F.coalesce(out, F.lit(float(fill)))


def rate(n: ColumnOrName, population: ColumnOrName, per: int = 100_000, digits: int = 2) -> Column:
    """Events per ``per`` people."""
    return safe_ratio(n, population, scale=per, digits=digits)


def int_trunc(c: ColumnOrName) -> Column:
    """Integer part, towards zero; null for NaN and for what 32 bits cannot hold."""
    x = _col(c)
    return F.when((x > -(2**31) - 1) & (x < 2**31), x).try_cast("int")
