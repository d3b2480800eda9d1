"""Column expressions; all of them stay inside whole-stage code generation."""

from .conditions import (
    bucketize,
    dominant_category,
    first_match,
    flag_any,
    override_if_in,
    yes_no_unknown,
)
from .dates import (
    as_date,
    date_lit,
    days_between,
    epi_week,
    epi_year,
    month_floor,
    safe_date,
    week_floor,
)
from .numeric import int_trunc, rate, round_half_even, safe_ratio
from .text import is_blank, normalize_text, series_title

__all__ = [
    "as_date",
    "bucketize",
    "date_lit",
    "days_between",
    "dominant_category",
    "epi_week",
    "epi_year",
    "first_match",
    "flag_any",
    "int_trunc",
    "is_blank",
    "month_floor",
    "normalize_text",
    "override_if_in",
    "rate",
    "round_half_even",
    "safe_date",
    "safe_ratio",
    "series_title",
    "week_floor",
    "yes_no_unknown",
]
