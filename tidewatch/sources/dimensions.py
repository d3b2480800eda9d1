"""Reference tables shipped with the package.

Each is a CSV of at most a few hundred rows under ``dims/``. They travel to the executors as
literal rows, so no path has to be visible there, and Spark knows their exact size.
"""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame, SparkSession

_DIMS = Path(__file__).resolve().parent.parent / "dims"

_TYPES = {
    "code": pa.int32(),
    "population": pa.int64(),
    "enrollment": pa.int64(),
    "rule": pa.int32(),
}


def dimension_names() -> list[str]:
    return sorted(p.stem for p in _DIMS.glob("*.csv"))


def dimension_table(name: str) -> pa.Table:
    if name not in dimension_names():
        raise KeyError(f"no reference table {name!r}; there are {dimension_names()}")
    return pacsv.read_csv(
        _DIMS / f"{name}.csv",
        convert_options=pacsv.ConvertOptions(
            column_types=_TYPES, strings_can_be_null=True, null_values=["NA"]
        ),
    )


def dimension(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame(dimension_table(name))
