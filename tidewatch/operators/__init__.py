"""Operators over any event table; column names are always parameters."""

from .clean import (
    across_matching,
    across_numeric,
    assert_unique,
    canonicalize,
    dedupe_by_priority,
    distinct_on,
    fill_blank,
    fill_zero,
    map_codes,
    parse_dates,
    parse_ints,
    unique_only,
    unmapped,
)
from .delta import classify_delta, new_records, once_only, symmetric_delta
from .link import anti_join, link_records, natural_full_join
from .panel import (
    count_where,
    dropped_events,
    fill_gaps,
    fill_spine,
    freq,
    pivot_counts,
    region_spine_counts,
    spine_counts,
    with_population,
    with_total,
)
from .report import (
    chart_series,
    flag_provisional,
    latest_rows,
    relabel,
    scorecard,
    search_rows,
    sort_desc,
    trailing_days,
    widen,
)
from .series import (
    cumulative,
    cumulative_all,
    lag_ratio,
    latest,
    open_count,
    trailing_mean,
    trailing_sum,
)

__all__ = [
    "across_matching",
    "across_numeric",
    "anti_join",
    "assert_unique",
    "canonicalize",
    "chart_series",
    "classify_delta",
    "count_where",
    "cumulative",
    "cumulative_all",
    "dedupe_by_priority",
    "distinct_on",
    "dropped_events",
    "fill_blank",
    "fill_gaps",
    "fill_spine",
    "fill_zero",
    "flag_provisional",
    "freq",
    "lag_ratio",
    "latest",
    "latest_rows",
    "link_records",
    "map_codes",
    "natural_full_join",
    "new_records",
    "once_only",
    "open_count",
    "parse_dates",
    "parse_ints",
    "pivot_counts",
    "region_spine_counts",
    "relabel",
    "scorecard",
    "search_rows",
    "sort_desc",
    "spine_counts",
    "symmetric_delta",
    "trailing_days",
    "trailing_mean",
    "trailing_sum",
    "unique_only",
    "unmapped",
    "widen",
    "with_population",
    "with_total",
]
