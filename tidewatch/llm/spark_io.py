"""Small helpers around Spark that the operators of this package share."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Most bytes of an Arrow batch between an executor and its Python workers.
BATCH_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of this session to ``BATCH_BYTES``.

    Tasks look at about a megabyte of text at a time, while a batch of Spark's ten thousand rows is held
    several times over, by the executor and by the worker, which both keep the memory for later stages.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder of the cluster."""
    return f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "staged") -> DataFrame:
    """Write a frame to the shared folder and go on from the files.

    This cuts the lineage and survives the loss of executors. The folder goes with the shared
    folder's own cleaning; ``spark_io.drop`` removes it earlier.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Remove the files of a frame that ``staged`` returned."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def split_join(rows: DataFrame, other: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """Join in which adaptive execution can split a hot key of ``rows``.

    It leaves a shuffle alone that an aggregation on the same key uses as well; with the keys
    wrapped, both sides are shuffled for the join itself. Null keys equal each other.
    """
    keys = [keys] if isinstance(keys, str) else keys
    other = other.withColumn("_key", F.struct(*keys)).drop(*keys)
    return rows.withColumn("_key", F.struct(*keys)).join(other, "_key", how).drop("_key")


def text_rows(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The given columns and the text, a null as an empty text."""
    return docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of the given schema; plain arrays are converted."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c := columns[f.name], (pa.Array,)) else pa.array(c, f.type) for f in schema],
        schema=schema,
    )
