"""Text expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .conditions import first_match
from .dates import ColumnOrName, _col

_PLAIN_ALTERNATION = re.compile(r"[\w |-]+")


def _matches(c: Column, pattern: str) -> Column:
    """Regex test; an alternation of plain words becomes substring tests, which cost far less."""
    if _PLAIN_ALTERNATION.fullmatch(pattern):
        words = [c.contains(word) for word in pattern.split("|")]
        test = words[0]
        for word in words[1:]:
            test = test | word
        return test
    return c.rlike(pattern)


def normalize_text(c: ColumnOrName, rules: Sequence[tuple[str, str]]) -> Column:
    """Canonical value of the first matching pattern, in order; otherwise the text itself."""
    c = _col(c)
    return first_match([(_matches(c, pattern), value) for pattern, value in rules], c)


def is_blank(c: ColumnOrName) -> Column:
    return F.coalesce(_col(c), F.lit("")) == ""


def series_title(prefix: str, c: ColumnOrName) -> Column:
    return F.concat_ws(" ", F.lit(prefix), _col(c))
