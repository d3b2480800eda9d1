"""Queries over the benchmark tables, and the SQL they are checked against."""

from . import basics, exchange, panels, schools  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
