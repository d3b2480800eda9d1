"""Which version of something holds: a log of small numbered pointer files.

Data lies in folders that are written once and never touched again. What holds is said by the newest
pointer file of a log; a commit adds the next one and replaces nothing. A run that dies before its
commit has changed nothing for readers, one that dies after it has changed everything, and two runs
that commit at once cannot both take the same number.
"""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import SparkSession

from ..session import file_system, folders, remove

LOG = "_versions"
_POINTER = re.compile(r"(\d{10})\.json")


def _numbers(spark: SparkSession, base: str) -> list[int]:
    fs, where = file_system(spark, f"{base}/{LOG}")
    if not fs.exists(where):
        return []
    found = (_POINTER.fullmatch(f.getPath().getName()) for f in fs.listStatus(where))
    return sorted(int(m[1]) for m in found if m)


def _read(spark: SparkSession, base: str, number: int) -> dict[str, Any]:
    text = spark.read.text(f"{base}/{LOG}/{number:010d}.json", wholetext=True).first()[0]
    return json.loads(text)


def current(spark: SparkSession, base: str) -> dict[str, Any]:
    """What the newest pointer says; empty before the first commit."""
    numbers = _numbers(spark, base)
    return _read(spark, base, numbers[-1]) if numbers else {}


def commit(spark: SparkSession, base: str, content: dict[str, Any]) -> int:
    """Make ``content`` what holds, and return its number.

    The file is written under a name that readers ignore and moved to the next number, which must be
    free: where another run was faster, this one fails and leaves what that run committed.
    """
    number = max(_numbers(spark, base), default=0) + 1
    fs, passing = file_system(spark, f"{base}/{LOG}/_passing-{number:010d}")
    _, place = file_system(spark, f"{base}/{LOG}/{number:010d}.json")
    out = fs.create(passing, False)
    try:
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    finally:
        out.close()
    if fs.exists(place) or not fs.rename(passing, place):
        fs.delete(passing, False)
        raise OSError(f"another run has committed version {number} of {base}")
    return number


def prune(spark: SparkSession, base: str, keep: int = 3) -> list[str]:
    """Remove the versions that none of the newest ``keep`` pointers names; returns their folders.

    Call it when no reader is at an older version and no run is writing.
    """
    numbers = _numbers(spark, base)
    named: set[str] = set()
    for n in numbers[-keep:]:
        named |= set(_read(spark, base, n).get("folders", {}).values())
    gone = []
    for version in folders(spark, f"{base}/data"):
        inside = folders(spark, f"{base}/data/{version}")
        unused = [name for name in inside if f"data/{version}/{name}" not in named]
        gone += [f"data/{version}/{name}" for name in unused]
        if len(unused) == len(inside):
            remove(spark, f"{base}/data/{version}")
        else:
            for name in unused:
                remove(spark, f"{base}/data/{version}/{name}")
    for n in numbers[:-keep]:
        remove(spark, f"{base}/{LOG}/{n:010d}.json")
    return gone
