"""Line-level extracts and previous snapshots."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import as_date
from ..session import folders
from . import commits

INPUT_ORDER = "input_order"


def normalize_columns(df: DataFrame) -> DataFrame:
    """Lower snake-case names: dots, spaces and other punctuation become underscores."""
    names = [re.sub(r"\W+", "_", c.strip()).strip("_").lower() for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"column names collide once normalised: {names}")
    return df.toDF(*names)


def with_input_order(df: DataFrame, name: str = INPUT_ORDER) -> DataFrame:
    """Position of each row in the files it was read from, for keep-first rules.

    A split is read front to back by one task, so path, split offset and the running id order
    the rows as they stand in the files, however the splits were scheduled. Call it on the
    frame a reader returned, before any shuffle.
    """
    return df.withColumn(
        name,
        F.struct(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("offset"),
            F.monotonically_increasing_id().alias("row"),
        ),
    )


def read_extract(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    *,
    drop_first: bool = False,
    normalize: bool = True,
    input_order: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """Header CSV with ``NA`` as null and doubled quotes inside quoted text.

    Without a schema every column is read as text, which spares the extra pass type inference
    costs; cast the columns you need. ``schema`` names and types the columns by position; a value
    its type cannot hold is null. ``drop_first`` drops the row-number column some exports lead
    with. Unquoted blanks arrive as null: see ``operators.fill_blank``.

    Text with line breaks needs ``multi_line``, which reads each file in one task, so deliver
    large extracts as many files. Without it a record broken over lines stops the job.
    """
    reader = (
        spark.read.option("header", True).option("nullValue", "NA").option("quote", '"')
        .option("escape", '"').option("multiLine", multi_line).option("mode", "FAILFAST")
        .option("columnPruning", False)
    )
    types = None
    if schema is not None:
        types = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        text = T.StructType([T.StructField(f.name, T.StringType()) for f in types.fields])
        reader = reader.schema(text).option("enforceSchema", True)
    df = reader.csv(path)
    if types is not None:
        df = df.withColumns({f.name: _typed(f) for f in types.fields})
    names = df.columns
    if input_order:
        df = with_input_order(df)
    if drop_first:
        df = df.drop(names[0])
    return normalize_columns(df) if normalize else df


def _typed(field: T.StructField) -> Column:
    return F.col(f"`{field.name}`").try_cast(field.dataType)


_SNAPSHOT = re.compile(r"snapshot_date=(\d{4}-\d{2}-\d{2})")


def _snapshots(spark: SparkSession, path: str) -> dict[dt.date, str]:
    """Folder of each day's snapshot: as committed, or by its own name where it came from elsewhere."""
    named = (_SNAPSHOT.fullmatch(name) for name in folders(spark, path))
    found = {dt.date.fromisoformat(m[1]): m[0] for m in named if m}
    committed = commits.current(spark, path).get("folders", {})
    return {**found, **{dt.date.fromisoformat(day): folder for day, folder in committed.items()}}


def snapshot_dates(spark: SparkSession, path: str) -> list[dt.date]:
    """Days that have a snapshot; no rows are read."""
    return sorted(_snapshots(spark, path))


def latest_snapshot_date(spark: SparkSession, path: str, before: dt.date | str) -> dt.date | None:
    """Newest day with a snapshot earlier than ``before``."""
    return max((d for d in snapshot_dates(spark, path) if d < as_date(before)), default=None)


def read_snapshot(
    spark: SparkSession,
    path: str,
    before: dt.date | str,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """The newest snapshot earlier than ``before``, also if it has no rows.

    Where there is none yet, as on a first run, the result is an empty frame of ``schema``, or of
    the columns a later snapshot has.
    """
    there = _snapshots(spark, path)
    newest = max((d for d in there if d < as_date(before)), default=None)
    if newest is not None:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(f"{path}/{there[newest]}")
    if schema is None:
        if not there:
            raise ValueError(f"no snapshot under {path}; pass the schema of the first run")
        schema = spark.read.parquet(f"{path}/{there[min(there)]}").schema
    return spark.createDataFrame([], schema)
