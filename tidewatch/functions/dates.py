"""Date expressions. Nothing here reads the wall clock: the run date is always passed in."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_date(value: dt.date | str) -> dt.date:
    """A run date given as a date or ISO text, checked on the driver."""
    if isinstance(value, dt.datetime):
        return value.date()
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def date_lit(value: dt.date | str) -> Column:
    return F.lit(as_date(value))


def safe_date(c: ColumnOrName) -> Column:
    """Date or datetime text to a date; blank or malformed text becomes null."""
    return _col(c).try_cast("date")


def week_floor(c: ColumnOrName, week_start: int = 7) -> Column:
    """First day of the week of ``c``; ``week_start`` counts Monday as 1, so 7 is Sunday."""
    back = F.pmod(F.dayofweek(_col(c)) - F.lit(week_start % 7 + 1), F.lit(7))
    return F.date_sub(_col(c).cast("date"), back.cast("int"))


def month_floor(c: ColumnOrName) -> Column:
    return F.trunc(_col(c), "month")


def _wednesday(c: ColumnOrName) -> Column:
    return F.date_add(week_floor(c), 3)


def epi_year(c: ColumnOrName) -> Column:
    """Year that owns the Sunday-start week: the one holding its Wednesday."""
    return F.year(_wednesday(c))


def epi_week(c: ColumnOrName) -> Column:
    """Epidemiological week number (1 to 53), Sunday to Saturday."""
    return (F.floor((F.dayofyear(_wednesday(c)) - 1) / 7) + 1).cast("int")


def days_between(end: ColumnOrName, start: ColumnOrName) -> Column:
    return F.datediff(_col(end), _col(start))
