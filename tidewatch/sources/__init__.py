"""Reading extracts, snapshots, reference tables and date spines; writing results."""

from .commits import prune
from .dimensions import dimension, dimension_names
from .extracts import (
    latest_snapshot_date,
    normalize_columns,
    read_extract,
    read_snapshot,
    snapshot_dates,
    with_input_order,
)
from .sinks import (
    commit_snapshot,
    publish,
    read_published,
    refresh_copies,
    write_by_recipient,
    write_extract,
)
from .spine import date_spine, dense_grid, main_stretch, off_stretch, spine_between

__all__ = [
    "commit_snapshot",
    "date_spine",
    "dense_grid",
    "dimension",
    "dimension_names",
    "latest_snapshot_date",
    "main_stretch",
    "normalize_columns",
    "off_stretch",
    "prune",
    "publish",
    "read_extract",
    "read_published",
    "read_snapshot",
    "refresh_copies",
    "snapshot_dates",
    "spine_between",
    "with_input_order",
    "write_by_recipient",
    "write_extract",
]
