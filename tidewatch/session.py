"""Session settings the jobs are written for."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution sizes the shuffles, turns joins with a side measured below the broadcast
# threshold into broadcast joins, and splits the partitions of hot keys.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Recording the Python call site of every column costs more than planning a wide panel.
    "spark.sql.dataFrameQueryContext.enabled": "false",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    app: str = "tidewatch", master: str | None = None, **conf: str
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, fallback: str | None = None) -> str:
    """The folder every executor sees, as the cluster names it in ``spark.checkpoint.dir``.

    Where the session names none, ``fallback`` is used, or in local mode, as in tests, a folder in the
    warehouse: never a machine-local temporary folder. On a cluster one of them has to be named.
    """
    folder = (
        spark.conf.get("spark.checkpoint.dir", None)
        or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        or fallback
    )
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors see in spark.checkpoint.dir")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared"
    return folder.rstrip("/")


def file_system(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The Hadoop file system of a path, and the path for it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    fs, where = file_system(spark, path)
    fs.delete(where, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below ``path``; none if it does not exist."""
    fs, where = file_system(spark, path)
    if not fs.exists(where):
        return []
    return sorted(f.getPath().getName() for f in fs.listStatus(where) if f.isDirectory())


# Folders that ``stage`` has written and ``clear_staged`` has not removed yet.
_STAGED: list[str] = []


def stage(df: DataFrame, fallback_dir: str | None = None) -> DataFrame:
    """Write out a frame several outputs are computed from, and go on from the files.

    The table lies in the shared folder, so it outlives any executor; being columnar, it is read
    back only as far as each output needs. Call ``clear_staged`` when the outputs are written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark, fallback_dir)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> None:
    """Remove the files of all staged frames; they hold line-level records."""
    while _STAGED:
        remove(spark, _STAGED.pop())
