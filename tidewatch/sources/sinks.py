"""Publishing result tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

from ..functions import as_date
from ..session import file_system, folders, remove
from . import commits


def _csv(df: DataFrame) -> DataFrameWriter:
    # Quotes inside a value are doubled, not escaped by a backslash.
    return (
        df.write.mode("overwrite").option("header", True).option("nullValue", "NA")
        .option("quote", '"').option("escape", '"').option("escapeQuotes", True)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    )


def write_extract(df: DataFrame, path: str) -> None:
    """Header CSV, nulls as ``NA``, quotes doubled; one file per partition."""
    _csv(df).csv(path)


def write_by_recipient(
    df: DataFrame, path: str, key: str = "recipient", recipients: Iterable[str] = ()
) -> None:
    """One folder of CSV files per recipient, in a single job.

    Whatever an earlier run left under ``path`` goes, so nobody is sent old rows. Each of
    ``recipients`` without rows gets a file with the header alone. The rebalance hint gathers a
    small recipient into one file and splits a large one over several tasks, so no recipient has
    to fit a task.
    """
    spark = df.sparkSession
    (
        _csv(df.hint("rebalance", key)).option("partitionOverwriteMode", "static")
        .partitionBy(key).csv(path)
    )
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    there = set(folders(spark, path))
    header = spark.createDataFrame([], df.drop(key).schema).coalesce(1)
    for name in recipients:
        folder = f"{key}={escape(name)}"
        if folder not in there:
            _csv(header).csv(f"{path}/{folder}")


def _swap(spark: SparkSession, new: str, place: str) -> None:
    """Put a written folder in the place of another; only for copies that can be made again."""
    remove(spark, place)
    fs, source = file_system(spark, new)
    _, target = file_system(spark, place)
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise OSError(f"cannot move {new} to {place}")


def publish(
    tables: Mapping[str, DataFrame],
    base: str,
    as_of: dt.date | str,
    lang: str = "en",
    order: Mapping[str, Sequence[str]] | None = None,
) -> dict[str, str]:
    """Write a bundle of tables as a new version and make it hold with one commit.

    Tables are written once, to folders that no other version has, and the pointer that names them
    is the only thing added to what readers look at (see ``read_published``): a failure on the way
    leaves the old bundle whole. Tables the bundle does not have stay as the version before had them.
    Tables named in ``order`` are range-partitioned by those columns and sorted, so a reader who
    filters on them skips files and row groups. The language is part of the path, so two languages
    never overwrite each other; the tables are published as they are (see ``operators.relabel``).

    The plain copies under ``as_of=<day>`` and ``latest`` follow the commit. They are for readers who
    know paths only; ``refresh_copies`` makes them again after a failure.
    """
    written, order = {}, order or {}
    if not tables:
        return written
    spark = next(iter(tables.values())).sparkSession
    home, day = f"{base}/{lang}", as_date(as_of).isoformat()
    version = f"data/{day}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        rows = df.orderBy(*order[name]) if name in order else df
        rows.write.parquet(f"{home}/{version}/{name}")
        written[name] = f"{home}/{version}/{name}"
    before = commits.current(spark, home)
    commits.commit(spark, home, {
        "as_of": {**before.get("as_of", {}), **dict.fromkeys(tables, day)},
        "folders": {**before.get("folders", {}), **{name: f"{version}/{name}" for name in tables}},
        "order": {**before.get("order", {}), **{name: list(order.get(name, ())) for name in tables}},
        "changed": sorted(tables),
    })
    refresh_copies(spark, base, lang)
    return written


def refresh_copies(spark: SparkSession, base: str, lang: str = "en") -> None:
    """Make the plain copies of what holds: the day's tables, and ``latest`` with all of them.

    Each copy is written aside and then put in place. Tables under ``latest`` that were published
    before there were versions stay.
    """
    home = f"{base}/{lang}"
    state = commits.current(spark, home)
    passing = f"{home}/_latest-{uuid.uuid4().hex}"

    def copy(source: str, place: str, by: Sequence[str]) -> None:
        rows = spark.read.parquet(source)
        (rows.orderBy(*by) if by else rows).write.parquet(place)

    for name in state["changed"]:
        aside = f"{home}/_dated-{uuid.uuid4().hex}"
        copy(f"{home}/{state['folders'][name]}", aside, state["order"][name])
        _swap(spark, aside, f"{home}/as_of={state['as_of'][name]}/{name}")
    for name in folders(spark, f"{home}/latest"):
        if name not in state["folders"]:
            copy(f"{home}/latest/{name}", f"{passing}/{name}", ())
    for name, folder in state["folders"].items():
        copy(f"{home}/{folder}", f"{passing}/{name}", state["order"][name])
    _swap(spark, passing, f"{home}/latest")


def read_published(spark: SparkSession, base: str, name: str, lang: str = "en") -> DataFrame:
    """A table of the bundle that holds, as its pointer names it."""
    found = commits.current(spark, f"{base}/{lang}").get("folders", {})
    if name not in found:
        raise ValueError(f"no table {name!r} is published under {base}/{lang}")
    return spark.read.parquet(f"{base}/{lang}/{found[name]}")


def commit_snapshot(df: DataFrame, path: str, as_of: dt.date | str) -> None:
    """Store ``df`` as the snapshot of ``as_of``; other snapshots stay as they are.

    Call it last. The rows are written to a folder of their own, and the snapshot is theirs when the
    pointer that names it is there: until then the day keeps what it had. A snapshot without rows
    is one.
    """
    spark, day = df.sparkSession, as_date(as_of).isoformat()
    folder = f"data/{day}-{uuid.uuid4().hex}/rows"
    df.write.parquet(f"{path}/{folder}")
    before = commits.current(spark, path).get("folders", {})
    commits.commit(spark, path, {"folders": {**before, day: folder}})
