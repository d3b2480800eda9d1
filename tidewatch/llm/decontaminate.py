"""Benchmark items found in documents: item-sized windows by their weighted word shingles.

A window of a document has as many words as an item. Window and item match by the exact weighted
Jaccard similarity of their shingle sets. A shingle weighs ``1 + ln(items / items that have it)``;
one that no item has weighs as much as one that a single item has.

Windows are taken at every word, for every length that items have. One whose shingles in the benchmark
weigh too little for any item of its length is out at once. The others get a SimHash fingerprint of
their weighted shingles, and a multi-index over ``RADIUS + 1`` blocks of the bits gives every item
of the window's length whose fingerprint is within ``RADIUS`` bits: of so many blocks at least one
is equal. All of these pairs are decided by exact similarity.

A fingerprint is an estimate, so some matches near the threshold are further apart than that. A bound
without loss proposes the rest: a match shares at least ``SIMILARITY`` of the item's weight, so it
holds one of the item's heaviest shingles that make up more than the rest of the weight. These are
indexed; in a text that holds one, the windows whose shared weight can reach the threshold join the
candidates, and are decided alike. (``Benchmark.candidates`` takes the sources one by one, to measure
what each finds.)

The benchmark is taken in blocks of at most ``ITEM_BYTES`` of text, one pass over the documents each,
so what is sent to the executors is bounded however long the benchmark is. Weights are those of the
whole benchmark: with several blocks, shingles are counted over all items first, and the windows of a
block whose other shingles may weigh little are decided after a join with these counts, so that blocks
change no result. (Only the fingerprints of such windows take unknown shingles as rare ones.)
Documents are shuffled only to drop some of them by several blocks.

Defined results: lower-casing covers A-Z; an item with fewer words than a shingle is one shingle;
a null or empty item matches nothing; a null or empty text holds nothing; a window that meets the
end of its document is shorter; every row is judged for itself, whatever its id; repeated items are
reported each; other columns are ignored.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import LOWER, groups, mix, segment_keys, utf8, windows, words
from .spark_io import split_join, staged, text_rows

SHINGLE, SIMILARITY, RADIUS, ITEM_BYTES = 5, 0.8, 24, 8 << 20
#: Where candidates come from: fingerprints, and the bound without loss.
SOURCES = ("prints", "bound")
#: What rounding may take from a bound.
_SLACK = 1e-9
_U = np.uint64
_BITS = np.arange(64, dtype=_U)
#: Shingles of windows that are looked at together.
_AT_ONCE = 1 << 14
_CUTS = np.linspace(0, 64, RADIUS + 2).astype(int)


def simhash(grams: np.ndarray, weights: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the runs ``[start, end)`` of weighted shingles, each taken once in a run."""
    signs = (((mix(grams)[:, None] >> _BITS) & _U(1)).astype(np.float32) * 2 - 1) * weights[:, None]
    run = np.zeros((len(grams) + 1, 64))
    np.cumsum(signs, axis=0, out=run[1:])
    total = run[end] - run[start]
    before = _before(grams)
    again = np.flatnonzero(before >= 0)
    if len(again):
        # What a run holds for a second time is taken off.
        inside = (before[again] >= start[:, None]) & (again < end[:, None])
        total -= inside.astype(np.float32) @ signs[again].astype(np.float32)
    return np.packbits(total > 0, axis=1, bitorder="little").view(_U).ravel()


class Match(NamedTuple):
    doc: int
    item: int
    similarity: float
    start: int
    n_words: int


class Candidates(NamedTuple):
    """Windows of one text that may match an item."""

    doc: int
    item: int
    start: np.ndarray
    end: np.ndarray
    own: np.ndarray  # weight of the shingles of the benchmark
    both: np.ndarray  # weight of those of the item
    foreign: np.ndarray  # which shingles are not of the benchmark, windows x shingles
    grams: np.ndarray


class Benchmark:
    """A block of benchmark items, ready to be looked for."""

    def __init__(self, ids: list, texts: list, items: int = 0, counts: pa.Table | None = None) -> None:
        """Of one block: ``items`` of the whole benchmark, and in how many of them each ``gram`` is (``n``)."""
        data, offsets = utf8(pa.array(texts, pa.string()))
        w = words(data, offsets)
        keys = segment_keys(data, w.start, w.end, LOWER)
        count = np.diff(w.first)
        self.ids, self.words, self.grams = [], [], []
        for k in np.flatnonzero(count):
            own = keys[w.first[k] : w.first[k + 1]]
            size = min(SHINGLE, len(own))
            self.ids.append(ids[k])
            self.words.append(len(own))
            self.grams.append(windows(own, np.zeros(len(own), int), size)[0])
        self.sets = [np.unique(g) for g in self.grams]
        self.all, seen = np.unique(np.concatenate([np.empty(0, _U), *self.sets]), return_counts=True)
        if counts is not None:
            gram = counts.column("gram").to_numpy().view(_U)
            order = np.argsort(gram)
            seen = counts.column("n").to_numpy()[order[np.searchsorted(gram[order], self.all)]]
        self.rare = 1 + float(np.log(max(items, len(self.ids), 1)))
        self.weight = self.rare - np.log(np.maximum(seen, 1))
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.all >> _U(48)).astype(np.int64)] = True
        self.total = [float(self.weigh(s)[0].sum()) for s in self.sets]
        self.numbers = [np.searchsorted(self.all, s) for s in self.sets]
        # The heaviest shingles of an item, so many that the others weigh less than SIMILARITY of it.
        gram, item = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k, own in enumerate(self.numbers):
            own = own[np.argsort(-self.weight[own], kind="stable")]
            run = np.cumsum(self.weight[own])
            own = own[: np.searchsorted(run, (1 - SIMILARITY + _SLACK) * self.total[k], "right") + 1]
            gram.append(own)
            item.append(np.full(len(own), k))
        gram, item = np.concatenate(gram), np.concatenate(item)
        self.owner = item[np.argsort(gram, kind="stable")]
        self.owned = np.searchsorted(np.sort(gram), np.arange(len(self.all) + 1))

    @functools.cached_property
    def prints(self) -> np.ndarray:
        return np.array(
            [simhash(g, self.weigh(g)[0], np.array([0]), np.array([len(g)]))[0] for g in self.grams], _U
        )

    @functools.cached_property
    def lengths(self) -> np.ndarray:
        """Words in a shingle and shingles in a window, of every kind of item."""
        return np.unique(self._kinds, axis=0)

    @property
    def _kinds(self) -> np.ndarray:
        kinds = [(min(SHINGLE, n), len(g)) for n, g in zip(self.words, self.grams, strict=True)]
        return np.array(kinds, np.int64).reshape(-1, 2)

    @functools.cached_property
    def kind(self) -> np.ndarray:
        """Of each item, which of ``lengths`` it has."""
        return np.unique(self._kinds, axis=0, return_inverse=True)[1].reshape(-1)

    @functools.cached_property
    def least(self) -> np.ndarray:
        """The least weight that an item of each kind must share."""
        out = np.full(len(self.lengths), np.inf)
        np.minimum.at(out, self.kind, (SIMILARITY - _SLACK) * np.array(self.total))
        return out

    @functools.cached_property
    def blocks(self) -> list[tuple]:
        """Items sorted by kind and bits, for each block of the bits."""
        out = []
        for a, b in zip(_CUTS[:-1], _CUTS[1:], strict=True):
            value = self.block(self.prints, self.kind, a, b)
            order = np.argsort(value, kind="stable")
            out.append((a, b, value[order], order))
        return out

    @staticmethod
    def block(prints: np.ndarray, kind: np.ndarray, a: int, b: int) -> np.ndarray:
        return ((prints >> _U(a)) & _U((1 << int(b - a)) - 1)).astype(np.int64) | kind << int(b - a)

    def weigh(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight of each shingle, and its number in the benchmark or -1."""
        weight, number = np.full(len(grams), self.rare), np.full(len(grams), -1, np.int64)
        maybe = np.flatnonzero(self.filter[(grams >> _U(48)).astype(np.int64)])
        if len(maybe) and len(self.all):
            spot = np.minimum(np.searchsorted(self.all, grams[maybe]), len(self.all) - 1)
            hit = self.all[spot] == grams[maybe]
            weight[maybe[hit]], number[maybe[hit]] = self.weight[spot[hit]], spot[hit]
        return weight, number

    def near(self, prints: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of window and item of a kind whose fingerprints differ in at most ``RADIUS`` bits."""
        pairs = []
        for a, b, value, order in self.blocks:
            own = self.block(prints, kind, a, b)
            lo, hi = np.searchsorted(value, own, "left"), np.searchsorted(value, own, "right")
            n = hi - lo
            w = np.repeat(np.arange(len(prints)), n)
            i = order[np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)]
            close = np.bitwise_count(prints[w] ^ self.prints[i]) <= RADIUS
            pairs.append(w[close] * len(self.ids) + i[close])
        pairs = np.unique(np.concatenate(pairs))
        return pairs // len(self.ids), pairs % len(self.ids)

    def search(self, data: np.ndarray, offsets: np.ndarray, sources: tuple = SOURCES) -> list[Match]:
        """The best window of each item in each of consecutive texts, if similar enough."""
        best: dict[tuple[int, int], Match] = {}
        for c in self.candidates(data, offsets, sources):
            own = c.own + c.foreign.sum(1) * self.rare
            sim = np.round(c.both / (own + self.total[c.item] - c.both), 12)
            k = int(np.argmax(sim))
            if sim[k] < SIMILARITY:
                continue
            old = best.get((c.doc, c.item))
            if old is None or (sim[k], -c.start[k]) > (old.similarity, -old.start):
                size = min(SHINGLE, self.words[c.item])
                n = int(c.end[k] - c.start[k]) + size - 1
                best[c.doc, c.item] = Match(c.doc, c.item, float(sim[k]), int(c.start[k]), n)
        return [best[k] for k in sorted(best)]

    def candidates(self, data: np.ndarray, offsets: np.ndarray, sources: tuple = SOURCES):
        """Windows near an item by fingerprint, and those that share enough of one to reach the threshold."""
        w = words(data, offsets)
        keys = segment_keys(data, w.start, w.end, LOWER)
        for size in sorted({min(SHINGLE, n) for n in self.words}):
            grams, at = windows(keys, w.doc, size)
            weight, number = self.weigh(grams)
            hits = np.flatnonzero(number >= 0)
            if not len(hits):
                continue
            doc = w.doc[at]
            for d in np.unique(doc[hits]).tolist():
                lo, hi = np.searchsorted(doc, [d, d + 1])
                yield from self._in_text(d, size, grams[lo:hi], weight[lo:hi], number[lo:hi], sources)

    def _in_text(self, doc, size, grams, weight, number, sources):
        found: dict[int, list[np.ndarray]] = {}
        if "prints" in sources:
            self._by_prints(found, size, grams, weight, number)
        if "bound" in sources:
            self._by_bound(found, size, grams, weight, number)
        before = _before(grams) if found else None
        for item in sorted(found):
            length, own = len(self.grams[item]), self.numbers[item]
            shared = own[np.minimum(np.searchsorted(own, number), len(own) - 1)] == number
            start = np.unique(np.concatenate(found[item]))
            step = max(1, (1 << 20) // length)
            for p in range(0, len(start), step):
                s = start[p : p + step]
                at = s[:, None] + np.arange(length)
                # Of equal shingles in a window only the first counts.
                there = at < len(grams)
                at = np.minimum(at, len(grams) - 1)
                there &= before[at] < s[:, None]
                known = weight[at] * (there & (number[at] >= 0))
                yield Candidates(
                    doc, item, s, np.minimum(s + length, len(grams)), known.sum(1),
                    (known * shared[at]).sum(1), there & (number[at] < 0), grams[at],
                )

    def _by_prints(self, found, size, grams, weight, number):
        """Windows within ``RADIUS`` bits of an item of their length."""
        hits = np.flatnonzero(number >= 0)
        starts = [
            _reaching(hits, weight, int(n), least) if of == size else hits[:0]
            for (of, n), least in zip(self.lengths, self.least, strict=True)
        ]
        kind = np.repeat(np.arange(len(starts)), [len(s) for s in starts])
        start = np.concatenate(starts)
        order = np.argsort(start, kind="stable")
        start, kind = start[order], kind[order]
        length = self.lengths[kind, 1]
        covered = np.cumsum(length)
        p = 0
        while p < len(start):
            # As many windows as hold so many shingles, one at least.
            q = int(np.searchsorted(covered, covered[p] - length[p] + _AT_ONCE, "right"))
            q = max(p + 1, min(q, p + 1024))
            s, e = start[p:q], np.minimum(start[p:q] + length[p:q], len(grams))
            # The shingles of these windows, without what lies between.
            n = e - s
            at = np.unique(np.arange(n.sum()) + np.repeat(s - np.cumsum(n) + n, n))
            prints = simhash(grams[at], weight[at], np.searchsorted(at, s), np.searchsorted(at, e))
            w, items = self.near(prints, kind[p:q])
            order = np.argsort(items, kind="stable")
            met, first = np.unique(items[order], return_index=True)
            for item, own in zip(met.tolist(), np.split(s[w[order]], first[1:]), strict=False):
                found.setdefault(item, []).append(own)
            p = q

    def _by_bound(self, found, size, grams, weight, number):
        """Windows of a text with a heavy shingle of an item that share enough of the item's weight."""
        hits = np.flatnonzero(number >= 0)
        held = number[hits]
        met = np.unique(held)
        met = met[self.owned[met + 1] > self.owned[met]]
        if not len(met):
            return
        items = np.unique(np.concatenate([self.owner[self.owned[g] : self.owned[g + 1]] for g in met]))
        for item in items.tolist():
            if min(SHINGLE, self.words[item]) != size:
                continue
            own = self.numbers[item]
            inside = own[np.minimum(np.searchsorted(own, held), len(own) - 1)] == held
            least = (SIMILARITY - _SLACK) * self.total[item]
            start = _reaching(hits[inside], weight, len(self.grams[item]), least)
            if len(start):
                found.setdefault(item, []).append(start)


def _reaching(spot: np.ndarray, weight: np.ndarray, length: int, least: float) -> np.ndarray:
    """Starts of the windows in which the shingles at ``spot`` weigh ``least`` or more."""
    run = np.concatenate([[0], np.cumsum(weight[spot])])
    if not len(spot) or run[-1] < least:
        return np.empty(0, np.int64)
    # A window holds no more than the one that starts at its first shingle of these.
    good = np.flatnonzero(run[np.searchsorted(spot, spot + length)] - run[:-1] >= least)
    if not len(good):
        return good
    low = np.maximum(np.where(good > 0, spot[good - 1] + 1, 0), spot[good] - length + 1)
    low = np.maximum(low, 0)
    n = spot[good] - low + 1
    start = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
    share = run[np.searchsorted(spot, start + length)] - run[np.repeat(good, n)]
    return start[share >= least]


def _before(grams: np.ndarray) -> np.ndarray:
    """Where each shingle of a text was last met, or -1."""
    order = np.argsort(grams, kind="stable")
    out = np.full(len(grams), -1, np.int64)
    same = grams[order[1:]] == grams[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def _items(benchmark: DataFrame) -> DataFrame:
    return text_rows(benchmark, F.col("item_id").cast("long"))


def _n_blocks(items: DataFrame, item_bytes: int) -> int:
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(-(-size // item_bytes))


def _grams(items: DataFrame) -> DataFrame:
    """The distinct shingles of every item with words."""
    def run(batches):
        for rows in batches:
            data, offsets = utf8(rows.column("text"))
            for i, j in groups(offsets):
                sets = Benchmark([0] * (j - i), rows.column("text").slice(i, j - i).to_pylist()).sets
                grams = np.concatenate([np.empty(0, _U), *sets])
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], ["gram"])

    return items.select("text").mapInArrow(run, "gram long")


def _worded(items: DataFrame) -> int:
    return items.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).count()


def blocks(benchmark: DataFrame, item_bytes: int = ITEM_BYTES, counts: DataFrame | None = None):
    """The benchmark in blocks of about ``item_bytes``; the items of one are on the driver at a time.

    Shingles weigh the same in each: they are counted over all items (``counts``, if done before).
    """
    items = _items(benchmark)
    n = _n_blocks(items, item_bytes)
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1)))
    if n > 1:
        total = _worded(items)
        counts = _counts(items) if counts is None else counts
    for k in range(n):
        part = items.filter(place == k)
        rows = part.toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        held = (rows.column("item_id").to_pylist(), rows.column("text").to_pylist())
        if n == 1:
            yield Benchmark(*held)
        else:
            yield Benchmark(*held, total, counts.join(_grams(part).distinct(), "gram", "left_semi").toArrow())


def _counts(items: DataFrame) -> DataFrame:
    """In how many items of the whole benchmark each shingle is."""
    return staged(_grams(items).groupBy("gram").agg(F.count("*").alias("n")), "shingles")


_FOUND = (
    "row long, item long, item_id long, start_word long, n_words long, "
    "own double, both double, total double, foreign array<long>"
)


def _found(docs: DataFrame, block: Benchmark, column: str, kind: str) -> DataFrame:
    """Windows that may match an item of a block, with the shingles whose weight other blocks know."""
    def run(batches):
        row = 0
        for rows in batches:
            data, offsets = utf8(rows.column("text"))
            name = rows.column(column)
            for i, j in groups(offsets):
                for c in block.candidates(data, offsets[i : j + 1]):
                    # A shingle weighs 1 at least.
                    best = c.both / (c.own + c.foreign.sum(1) + block.total[c.item] - c.both)
                    k = np.flatnonzero(best >= SIMILARITY - _SLACK)
                    size = min(SHINGLE, block.words[c.item])
                    where = c.foreign[k]
                    cut = np.concatenate([[0], np.cumsum(where.sum(1))]).astype(np.int32)
                    m = len(k)
                    yield pa.RecordBatch.from_arrays(
                        [name.take(pa.array(np.full(m, i + c.doc))), pa.array(np.full(m, row + i + c.doc)),
                         pa.array(np.full(m, c.item)), pa.array([block.ids[c.item]] * m, pa.int64()),
                         pa.array(c.start[k]), pa.array(c.end[k] - c.start[k] + size - 1),
                         pa.array(c.own[k]), pa.array(c.both[k]), pa.array(np.full(m, block.total[c.item])),
                         pa.ListArray.from_arrays(pa.array(cut), pa.array(c.grams[k][where].view(np.int64)))],
                        [column, *(f.split()[0] for f in _FOUND.split(", "))],
                    )
            row += rows.num_rows

    found = docs.mapInArrow(run, f"{column} {kind}, {_FOUND}")
    # Rows are numbered within a task.
    return found.withColumn("task", F.spark_partition_id()).withColumn("window", F.monotonically_increasing_id())


def _decided(found: DataFrame, counts: DataFrame, rare: float, column: str) -> DataFrame:
    """The best window of each row and item, once the shingles of other blocks are weighed."""
    met = found.select("window", F.explode("foreign").alias("gram"))
    more = (
        split_join(met, counts, "gram", "left").groupBy("window")
        .agg(F.sum(F.lit(rare) - F.log(F.coalesce("n", F.lit(1)).cast("double"))).alias("more"))
    )
    own = F.col("own") + F.coalesce("more", F.lit(0.0))
    sim = F.round(F.col("both") / (own + F.col("total") - F.col("both")), 12)
    near = found.drop("foreign").join(more, "window", "left").withColumn("similarity", sim)
    rest = [F.col(c) for c in (column, "item_id", "similarity", "start_word", "n_words")]
    best = F.min(F.struct((-F.col("similarity")).alias("far"), F.col("start_word").alias("at"), F.struct(*rest).alias("match")))
    return (
        near.filter(F.col("similarity") >= SIMILARITY).groupBy("task", "row", "item")
        .agg(best.alias("best")).select("best.match.*")
    )


def matches(docs: DataFrame, benchmark: DataFrame, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``doc_id``, ``item_id``, ``similarity``, ``start_word`` and ``n_words`` of what was found."""
    docs = text_rows(docs, F.col("doc_id").cast("long"))
    names = ["doc_id", "item_id", "similarity", "start_word", "n_words"]
    schema = "doc_id long, item_id long, similarity double, start_word long, n_words long"
    out = docs.sparkSession.createDataFrame([], schema)
    if _n_blocks(_items(benchmark), item_bytes) > 1:
        counts = _counts(_items(benchmark))
        for block in blocks(benchmark, item_bytes, counts):
            found = staged(_found(docs, block, "doc_id", "long"), "windows")
            out = out.unionByName(_decided(found, counts, block.rare, "doc_id"))
        return out
    for block in blocks(benchmark, item_bytes):

        def run(batches, block=block):
            for rows in batches:
                data, offsets = utf8(rows.column("text"))
                ids = rows.column("doc_id")
                for i, j in groups(offsets):
                    found = block.search(data, offsets[i : j + 1])
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array([i + m.doc for m in found], pa.int64())),
                         pa.array([block.ids[m.item] for m in found], pa.int64()),
                         pa.array([m.similarity for m in found], pa.float64()),
                         pa.array([m.start for m in found], pa.int64()),
                         pa.array([m.n_words for m in found], pa.int64())],
                        names,
                    )

        out = out.unionByName(docs.mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The documents that hold no benchmark item, with their columns as they are."""
    if _n_blocks(_items(benchmark), item_bytes) > 1:
        # What a text holds depends on the text alone.
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        counts = _counts(_items(benchmark))
        named = docs.select(F.sha2(text, 256).alias("digest"), text.alias("text"))
        hit = None
        for block in blocks(benchmark, item_bytes, counts):
            found = staged(_found(named, block, "digest", "string"), "windows")
            own = _decided(found, counts, block.rare, "digest").select("digest")
            hit = own if hit is None else hit.unionByName(own)
        hit = staged(hit.distinct(), "contaminated")
        whole = docs.select(F.struct(*docs.columns).alias("row"), F.sha2(text, 256).alias("digest"))
        return split_join(whole, hit, "digest", "left_anti").select("row.*")
    out = docs
    for block in blocks(benchmark, item_bytes):

        def run(batches, block=block):
            for rows in batches:
                inner = rows.column("row")
                data, offsets = utf8(inner.field(inner.type.get_field_index("text")))
                clean = np.ones(rows.num_rows, bool)
                for i, j in groups(offsets):
                    clean[[i + m.doc for m in block.search(data, offsets[i : j + 1])]] = False
                yield pa.RecordBatch.from_struct_array(inner.filter(pa.array(clean)))

        out = out.select(F.struct(*docs.columns).alias("row")).mapInArrow(run, docs.schema)
    return out
