"""Exact top-k by inner product with a dual-tree cover-tree search.

Queries and data are indexed together and searched node pair by node pair. For a query node with
centre ``q`` and covering radius ``s``, and a data node with ``p`` and ``r``, no inner product exceeds
``q.p + |q| r + |p| s + r s``; a pair goes once that is below the worst ``k``-th score that the queries
of the node hold so far.

* The top of the tree spans the cluster. Its centres are a farthest-first traversal of a sample (at
  most ``SAMPLE`` rows, the only thing drawn from a sample): the first so many of the traversal are the
  coarser levels, as in any cover tree. Every row belongs to the cell of its nearest centre; queries
  also to the nearest of the fewer centres of a coarser level. Radii cover all rows.
* Cells are cut at random into blocks of about ``ROWS`` rows, so one vector that a third of all rows
  repeat fills many blocks. Every query first meets the block it lies in, which gives a lower bound of
  its ``k``-th score. Pairs of query group and data cell that the bounds leave meet block by block.
* Below, each task builds the cover tree of its query block and of its data block and goes down both
  at once. Leaf pairs are scored by a matrix product, those with the highest bound first.

What a task holds is bounded by the block sizes. The driver sees the centres, and one row per cell and
query group: at most ``CELLS`` of each. Where bounds prune nothing, as among directions without
structure, every query meets every row, in blocks: work as queries times rows is inherent then.

Defined results: vectors that are null, or hold null or non-finite components, and rows without an id
take no part; a shorter vector counts as padded with zeros; a row is not its own candidate, but rows
that repeat its id are; an id repeated among the queries gets its answers once per row; ties go to
the smaller id. Scores are exact while below 2**53. Other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spark_io import split_join, staged

#: Rows in a data cell or block, queries in a group or block, most cells, rows that centres are from.
ROWS, QUERIES, CELLS, SAMPLE = 4096, 4096, 512, 8192
#: Points in a leaf, and children of a node.
LEAF, FAN = 64, 16
#: Numbers in one matrix of scores.
SCORES = 1 << 21


def farthest_first(points: np.ndarray, n: int, stop: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to ``n`` points, each farthest from those before; the nearest of them and its distance."""
    picks, nearest = [0], np.zeros(len(points), np.int64)
    square = np.einsum("ij,ij->i", points, points)
    away = np.maximum(square + square[0] - 2 * (points @ points[0]), 0)
    away[0] = 0
    while len(picks) < min(n, len(points)):
        far = int(np.argmax(away))
        if away[far] <= stop * stop:
            break
        new = np.maximum(square + square[far] - 2 * (points @ points[far]), 0)
        new[far] = 0
        closer = new < away
        nearest[closer] = len(picks)
        away = np.minimum(away, new)
        picks.append(far)
    return np.array(picks), nearest, np.sqrt(away)


class CoverTree:
    """Nodes over rows ``order[lo:hi]``: centre, covering radius and children.

    Children are a net of the node at half its radius. Where ``FAN`` centres cannot cover at half the
    radius, those are the children, with the radii they have.
    """

    def __init__(self, points: np.ndarray) -> None:
        self.order = np.arange(len(points))
        self.lo, self.hi, self.centre, self.radius, self.children = [], [], [], [], []
        self._node(points, 0, len(points), 0)
        todo = [0]
        while todo:
            node = todo.pop()
            lo, hi = self.lo[node], self.hi[node]
            if hi - lo <= LEAF or self.radius[node] == 0:
                continue
            own = self.order[lo:hi]
            first = np.flatnonzero(own == self.centre[node])
            own[[0, first[0]]] = own[[first[0], 0]]
            picks, nearest, _ = farthest_first(points[own], FAN, self.radius[node] / 2)
            if len(picks) == 1:
                continue
            by = np.argsort(nearest, kind="stable")
            cuts = lo + np.searchsorted(nearest[by], np.arange(len(picks) + 1))
            centres = own[picks]
            self.order[lo:hi] = own[by]
            for k, centre in enumerate(centres):
                child = self._node(points, int(cuts[k]), int(cuts[k + 1]), int(centre))
                self.children[node].append(child)
                todo.append(child)
        self.leaf = np.array([not c for c in self.children])
        self.lo, self.hi, self.radius = map(np.array, (self.lo, self.hi, self.radius))
        self.at = points[self.centre]
        self.length = np.sqrt(np.einsum("ij,ij->i", self.at, self.at))

    def _node(self, points: np.ndarray, lo: int, hi: int, centre: int) -> int:
        gap = points[self.order[lo:hi]] - points[centre]
        # A little more than the radius, for rounding.
        radius = float(np.sqrt(np.einsum("ij,ij->i", gap, gap).max(initial=0))) * (1 + 1e-9)
        for column, value in zip(
            (self.lo, self.hi, self.centre, self.radius, self.children), (lo, hi, centre, radius, []),
            strict=True,
        ):
            column.append(value)
        return len(self.lo) - 1


def bound(inner, a_length, a_radius, b_length, b_radius):
    """What no inner product between two balls exceeds, rounding allowed for."""
    size = (a_length + a_radius) * (b_length + b_radius)
    return inner + a_length * b_radius + b_length * a_radius + a_radius * b_radius + 1e-9 * size


class Best:
    """The best ``k`` of each query so far: pairs of score and candidate, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, k: int, least: np.ndarray) -> None:
        self.ids, self.k, self.least = ids, k, least.copy()
        self.score = [np.empty(0)] * len(least)
        self.row = [np.empty(0, np.int64)] * len(least)

    def add(self, query: int, score: np.ndarray, row: np.ndarray) -> None:
        score, row = np.append(self.score[query], score), np.append(self.row[query], row)
        take = np.lexsort((self.ids[row], -score))[: self.k]
        self.score[query], self.row[query] = score[take], row[take]
        if len(take) == self.k:
            self.least[query] = max(self.least[query], score[take[-1]])


def dual_tree(
    queries: np.ndarray, query_rows: np.ndarray, least: np.ndarray,
    data: np.ndarray, data_rows: np.ndarray, ids: np.ndarray, k: int,
) -> Best:
    """The best ``k`` rows of ``data`` for each query that score its ``least`` or more."""
    best = Best(ids, k, least)
    if not len(queries) or not len(data):
        return best
    q, d = CoverTree(queries), CoverTree(data)
    pairs = np.zeros((1, 2), np.int64)
    leaves = []
    while len(pairs):
        a, b = pairs.T
        worst = np.minimum.reduceat(np.append(best.least[q.order], np.inf), np.stack([q.lo, q.hi], 1).ravel())[::2]
        top = np.concatenate([
            bound(
                np.einsum("ij,ij->i", q.at[x], d.at[y]), q.length[x], q.radius[x], d.length[y], d.radius[y]
            ) for x, y in _parts(a, b)
        ])
        keep = top >= worst[a]
        a, b, top = a[keep], b[keep], top[keep]
        both = q.leaf[a] & d.leaf[b]
        leaves.append(np.stack([a[both], b[both], top[both]], 1))
        a, b = a[~both], b[~both]
        # The wider of two inner nodes is opened.
        open_q = ~q.leaf[a] & (d.leaf[b] | (q.radius[a] >= d.radius[b]))
        pairs = np.array(
            [(c, y) for x, y in zip(a[open_q], b[open_q], strict=True) for c in q.children[x]]
            + [(x, c) for x, y in zip(a[~open_q], b[~open_q], strict=True) for c in d.children[y]],
            np.int64,
        ).reshape(-1, 2)
    every = np.concatenate(leaves)
    if not len(every):
        return best
    every = every[np.lexsort((-every[:, 2], every[:, 0]))]
    cuts = np.flatnonzero(np.diff(every[:, 0], prepend=-1))
    for i, j in zip(cuts, np.append(cuts[1:], len(every)), strict=True):
        node = int(every[i, 0])
        own = q.order[q.lo[node] : q.hi[node]]
        room = 4 * LEAF  # few rows first: they raise the worst score for the rest
        while i < j:
            worst = best.least[own].min()
            if every[i, 2] < worst:
                break
            stop, n = i, 0
            while stop < j and every[stop, 2] >= worst and n < min(room, SCORES // len(own)):
                n += d.hi[int(every[stop, 1])] - d.lo[int(every[stop, 1])]
                stop += 1
            rows = np.concatenate([d.order[d.lo[y] : d.hi[y]] for y in every[i:stop, 1].astype(int)])
            _score(best, queries, query_rows, own, data, data_rows, rows)
            i, room = stop, 4 * room
    return best


def _parts(a: np.ndarray, b: np.ndarray, size: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(a), size):
        yield a[i : i + size], b[i : i + size]


def _score(best: Best, queries, query_rows, own, data, data_rows, rows) -> None:
    """Score rows for queries and keep those that may be among the best."""
    k, score = best.k, queries[own] @ data[rows].T
    # One more than k, for the query's own row.
    floor = best.least[own]
    if len(rows) > k:
        floor = np.maximum(floor, np.partition(score, len(rows) - k - 1, axis=1)[:, len(rows) - k - 1])
    hit, where = np.nonzero(score >= floor[:, None])
    other = data_rows[rows[where]] != query_rows[own[hit]]
    hit, where = hit[other], where[other]
    cuts = np.searchsorted(hit, np.arange(len(own) + 1))
    for n in np.flatnonzero(np.diff(cuts)):
        at = where[cuts[n] : cuts[n + 1]]
        best.add(int(own[n]), score[n, at], rows[at])


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Vectors as rows, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (n == size).all():
        return values.reshape(len(n), size)
    out = np.zeros((len(n), size))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)] = values
    return out


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _cells(rows: DataFrame, size: int, centres: np.ndarray, coarse: int) -> DataFrame:
    """Rows with the cell of the nearest centre, queries with a group too, and the distances."""
    length = np.einsum("ij,ij->i", centres, centres)

    def run(batches):
        for batch in batches:
            points = _matrix(batch.column("v"), size)
            cells, groups, far, wide = [], [], [], []
            for i in range(0, len(points), 4096):
                part = points[i : i + 4096]
                away = length - 2 * (part @ centres.T)
                cell, group = away.argmin(1), away[:, :coarse].argmin(1)
                cells.append(cell)
                groups.append(group)
                far.append(np.linalg.norm(part - centres[cell], axis=1))
                wide.append(np.linalg.norm(part - centres[group], axis=1))
            columns = [
                pa.array(np.concatenate(x or [np.empty(0)]), t)
                for x, t in ((cells, pa.int32()), (groups, pa.int32()), (far, pa.float64()), (wide, pa.float64()))
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns], [*batch.schema.names, "cell", "grp", "far", "wide"]
            )

    return rows.mapInArrow(
        lambda b: run(x for x in b if x.num_rows),
        "row long, id long, v array<double>, query boolean, cell int, grp int, far double, wide double",
    )


def _result(queries: pa.Table, best: Best) -> pa.Table:
    n = [len(x) for x in best.row]
    at = pa.array(np.repeat(np.arange(len(n)), n))
    score = np.concatenate([*best.score, np.empty(0)])
    return pa.table({
        "row": queries.column("row").take(at), "query_id": queries.column("id").take(at),
        "vec_id": pa.array(best.ids[np.concatenate([*best.row, np.empty(0, np.int64)])], pa.int64()),
        "score": pa.array(score, pa.float64()),
    })


_FOUND = "row long, query_id long, vec_id long, score double"


def top_k(
    rows: DataFrame, query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """The ``k`` rows with the highest inner product for each row that ``query`` selects.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` (a double).
    """
    spark = rows.sparkSession
    v = F.col(vector)
    base = staged(
        rows.filter(F.col(id_col).isNotNull() & usable(v)).select(
            F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
            v.cast("array<double>").alias("v"), F.coalesce(query, F.lit(False)).alias("query"),
        ), "vectors",
    )
    size, n, asked = base.agg(F.max(F.size("v")), F.count("*"), F.count_if("query")).first()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = base.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("v").toArrow()
    points = _matrix(sample.column("v"), size)
    cells, coarse = (min(CELLS, -(-x // y)) for x, y in ((n, ROWS), (asked, QUERIES)))
    centres = points[farthest_first(points, cells)[0]]
    coarse = min(coarse, len(centres))

    placed = staged(_cells(base, size, centres, coarse), "cells")
    spread = F.pmod(F.xxhash64("row"), F.lit(1 << 30))
    in_cell = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
    in_group = placed.filter("query").groupBy("grp").agg(F.count("*").alias("n"), F.max("wide").alias("wide")).collect()
    blocks = F.element_at(_literal({r.cell: -(-r.n // ROWS) for r in in_cell}), F.col("cell"))
    parts = F.element_at(_literal({r.grp: -(-r.n // QUERIES) for r in in_group}), F.col("grp"))
    placed = placed.withColumn("block", (spread % blocks).cast("int")).withColumn("part", (spread % parts).cast("int"))

    def near(table: pa.Table) -> pa.Table:
        own = table.filter(table.column("query"))
        point, ids = _matrix(table.column("v"), size), table.column("id").to_numpy()
        best = dual_tree(
            _matrix(own.column("v"), size), own.column("row").to_numpy(), np.full(own.num_rows, -np.inf),
            point, table.column("row").to_numpy(), ids, k,
        )
        return pa.table({"row": own.column("row"), "least": pa.array(best.least, pa.float64())})

    seeds = placed.select("row", "id", "v", "query", "cell", "block").groupBy("cell", "block").applyInArrow(near, "row long, least double")
    queries = staged(
        split_join(placed.filter("query").select("row", "id", "v", "grp", "part"), seeds, "row"), "queries"
    )
    worst = {r.grp: r.least for r in queries.groupBy("grp").agg(F.min("least").alias("least")).collect()}

    length = np.linalg.norm(centres, axis=1)
    left = [
        (g.grp, c.cell)
        for g in in_group for c in in_cell
        if bound(centres[g.grp] @ centres[c.cell], length[g.grp], g.wide * (1 + 1e-9), length[c.cell], c.far * (1 + 1e-9))
        >= worst[g.grp]
    ]
    tiles = (
        spark.createDataFrame(left, "grp int, cell int")
        .withColumn("block", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
        .withColumn("part", F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)))
    )
    keys = ["grp", "part", "cell", "block"]
    ask = queries.join(tiles, ["grp", "part"])
    have = placed.select("row", "id", "v", "cell", "block").join(tiles, ["cell", "block"])

    def meet(asking: pa.Table, table: pa.Table) -> pa.Table:
        best = dual_tree(
            _matrix(asking.column("v"), size), asking.column("row").to_numpy(), asking.column("least").to_numpy(),
            _matrix(table.column("v"), size), table.column("row").to_numpy(), table.column("id").to_numpy(), k,
        )
        return _result(asking, best)

    found = ask.groupBy(*keys).cogroup(have.groupBy(*keys)).applyInArrow(meet, _FOUND)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def _literal(numbers: dict[int, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])


def integer_top_k(rows: DataFrame, modulus: int = 50, k: int = 5) -> DataFrame:
    """``top_k`` of ``embeddings`` in steps of 1/256; queries are the ids divisible by ``modulus``."""
    steps = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    whole = F.when(usable(F.col("embedding")), steps)
    found = top_k(
        rows.select("vec_id", whole.alias("embedding")), F.col("vec_id") % modulus == 0, k
    )
    return found.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def oracle_sql(modulus: int = 50, k: int = 5) -> str:
    """The same in DuckDB's SQL: every query against every row."""
    return f"""
WITH v AS (
    SELECT vec_id, [floor(x::DOUBLE * 256) for x in embedding] AS v, row_number() OVER () AS row
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
    SELECT q.row, q.vec_id AS query_id, c.vec_id AS vec_id,
        list_inner_product(q.v, c.v)::BIGINT AS score
    FROM v AS q JOIN v AS c ON q.row <> c.row AND q.vec_id % {modulus} = 0)
SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= {k}
"""
