"""What changed between two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .clean import Keys, _keys, unique_only
from .link import _shared, anti_join, side_counts


def new_records(current: DataFrame, previous: DataFrame, key: Keys) -> DataFrame:
    """Current rows whose id the previous snapshot does not have."""
    return anti_join(current, previous, key)


def once_only(a: DataFrame, b: DataFrame, key: Keys) -> DataFrame:
    """Stack two snapshots, whatever columns each has, and keep the ids that occur once."""
    return unique_only(a.unionByName(b, allowMissingColumns=True), key)


def symmetric_delta(current: DataFrame, previous: DataFrame, key: Keys) -> DataFrame:
    """Full outer join on all shared columns, then drop every id that occurs more than once.

    What stays: ids found in one snapshot only, and ids whose row is identical in both. A changed
    row yields two output rows for its id, so it disappears.
    """
    keys = _keys(key)
    common = _shared(current, previous)
    rows = side_counts(
        current,
        previous,
        common,
        [c for c in current.columns if c not in common],
        [c for c in previous.columns if c not in common],
    ).withColumn("_single", (F.col("_m") <= 1) & (F.col("_n") <= 1))
    # Two distinct rows, or one that counts twice, rule an id out; the limit of two rows per id
    # holds before the shuffle, so a hot id stays cheap.
    seen = Window.partitionBy(*keys).orderBy("_single")
    return (
        rows.withColumn("_seen", F.row_number().over(seen))
        .filter("_seen <= 2")
        .withColumn("_rows", F.max("_seen").over(Window.partitionBy(*keys)))
        .filter("_rows = 1 AND _single")
        .drop("_seen", "_rows", "_m", "_n", "_single")
    )


def classify_delta(current: DataFrame, previous: DataFrame, key: Keys) -> DataFrame:
    """Each id as ``new``, ``removed``, ``changed`` or ``unchanged``, with its row counts.

    An id is unchanged when the two snapshots hold the same rows for it, duplicates included.
    Rows are compared by counting equal ones, so no join on the id takes place.
    """
    keys = _keys(key)
    return (
        side_counts(current, previous, _shared(current, previous))
        .groupBy(*keys)
        .agg(
            F.sum("_m").alias("rows_current"),
            F.sum("_n").alias("rows_previous"),
            F.max((F.col("_m") != F.col("_n")).cast("int")).alias("_differs"),
        )
        .withColumn(
            "change",
            F.when(F.col("rows_previous") == 0, "new")
            .when(F.col("rows_current") == 0, "removed")
            .when(F.col("_differs") == 1, "changed")
            .otherwise("unchanged"),
        )
        .select(*keys, "change", "rows_current", "rows_previous")
    )
