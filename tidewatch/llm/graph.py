"""Connected components of a graph given as edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_io import drop, split_join, staged

#: Edges that one task contracts.
LOCAL_EDGES = 500_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _contract(batches):
    """The edges of a task as stars: every node with the smallest of its component there."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    edges = pa.Table.from_batches(batches)
    u, v = edges.column("u").to_numpy(), edges.column("v").to_numpy()
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        after = np.minimum(after, after[after])
        after = after[label]
        if (after == label).all() and (label[a] == label[b]).all():
            break
        label = after
    own = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays(
        [pa.array(nodes[own], pa.string()), pa.array(nodes[label[own]], pa.string())], ["u", "v"]
    )


def _star_round(now: DataFrame) -> DataFrame:
    """Every node links its larger neighbours, then its smaller ones, to the smallest it knows."""
    both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = (
        split_join(both.filter("v > u"), low, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    return (
        split_join(large, least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v"))).distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node of its component, for every node with an edge.

    ``edges`` has the text columns ``a`` and ``b``. Tasks of about ``LOCAL_EDGES`` edges contract
    what they hold to stars; where there are several tasks, rounds of alternating stars between them
    go on until nothing changes. A star round is a minimum per node joined back, so a node of any
    degree is never gathered, and each round's edges are written to the shared folder.
    """
    now = staged(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")),
        "edges",
    )
    state = _state(now)
    while state[0]:
        tasks = -(-state[0] // LOCAL_EDGES)
        after = staged(now.coalesce(tasks).mapInArrow(_contract, "u string, v string"), "edges")
        drop(now)
        if tasks == 1:
            now = after
            break
        now = staged(_star_round(after), "edges")
        drop(after)
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
