"""Documents linked by the Jaccard similarity of their word n-grams.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of distinct ``n``-word
shingles. Equal sets are one class from the start, so copies are never compared.

1. Tiles. Sizes are banded; for a pair whose larger set lies in a band, at most ``K`` shingles are in
   one set only. Cutting the hash range into more than ``K`` parts therefore leaves a part in which
   both sets are equal, so sets with an equal part in an equal band (a tile) hold every linked pair
   and nothing is lost. Tiles with the same members are looked at once.
2. Bitmaps. Each set has a hashed bitmap of about two bits a shingle. Bits that only one side has
   bound the overlap of two sets from above. Pairs in a tile whose bound reaches the overlap they
   need make up groups; a tile returns a spanning forest of them, and what shares no more than
   boilerplate falls apart here.
3. Sorted arrays. Within a group the bound by wider bitmaps and then the exact intersection of the
   sorted arrays decide; pairs already connected are passed over. Components are those of all links.

Tiles and groups of many members are cut into blocks that are compared two by two. Tile keys are
shuffled once, as (key, id), and read in sorted order; arrays move once per document and block pair.

Defined results: lower-casing covers A-Z; a text with fewer than ``n`` words has its whole sequence
as one shingle; one without words (or a null) has none and links with nothing; rows that repeat an
id are documents of their own; rows without an id have no component; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .scan import EXACT, LOWER, groups, mix, segment_keys, utf8, windows, words
from .spark_io import split_join, staged, text_rows

#: Sets and bytes in one block of a tile or group.
BLOCK_SETS, BLOCK_BYTES = 1024, 16 << 20
#: Most bits of a bitmap that travels with tiles.
MAX_BITS = 1 << 15
_U, _WORD = np.uint64, r"[^\x20\x09-\x0D]"


def bands(percent: int, largest: int = 1 << 40, growth: float = 1.4) -> list[tuple[int, int, int]]:
    """Largest size, number of parts and spare parts of each band; in the first only equal sets link.

    With ``r`` spare parts, sets that differ in ``K`` shingles agree in ``r + 1`` parts at least, so
    up to ``r`` empty parts need not count.
    """
    differ = lambda u: 2 * u * (100 - percent) // (100 + percent)
    top = 1
    while differ(top + 1) == 0 and top < 1 << 20:
        top += 1
    out = [(top, 0, 0)]
    while out[-1][0] < largest and differ(1 << 40):
        top = max(top + 1, int(top * growth))
        k = differ(top)
        spare = 1 if k < 3 else 2 + math.ceil(3 * (k + 1) * math.exp(-top / growth / (k + 1)))
        out.append((top, k + 1 + spare, spare))
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of consecutive texts, ascending within each, and where each text's begin."""
    w = words(data, offsets)
    keys = segment_keys(data, w.start, w.end, LOWER)
    grams, at = windows(keys, w.doc, n)
    doc, count = w.doc[at], np.diff(w.first)
    for size in range(1, n):
        few = np.flatnonzero(count == size)
        whole, place = windows(keys, w.doc, size)
        pick = np.searchsorted(place, w.first[few])
        grams, doc = np.append(grams, whole[pick]), np.append(doc, few)
    order = np.argsort(grams, kind="stable")
    order = order[np.argsort(doc[order].astype(np.uint16), kind="stable")]
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(len(offsets)))


def part_keys(grams: np.ndarray, schemes: list[tuple[int, int, int]], percent: int) -> np.ndarray:
    """Keys of the tiles that one ascending set takes part in."""
    n, out = len(grams), []
    for band, (top, parts, spare) in enumerate(schemes):
        below = schemes[band - 1][0] if band else 0
        if top < n or not parts:
            continue
        if n <= below and n * 100 < percent * (below + 1):
            break
        part = ((grams >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        total, held = np.add.reduceat(mix(grams ^ EXACT[11]), first), part[first]
        if parts - len(held) > spare:
            # So many parts are empty that all equal ones may be: the empty ones count as well.
            empty = np.setdiff1d(np.arange(parts), held)
            total, held = np.append(total, np.zeros(len(empty), _U)), np.append(held, empty)
        out.append(mix(mix(total + held.astype(_U) * EXACT[13]) + _U(band + 1)))
    return np.concatenate(out) if out else np.empty(0, _U)


def bitmaps(sets: list[np.ndarray], width: int) -> np.ndarray:
    """One row of ``width`` bits for each set, as 64-bit words; ``width`` is a power of two."""
    bits = np.zeros((len(sets), width // 64), _U)
    for k, x in enumerate(sets):
        at = (x & _U(width - 1)).astype(np.int64)
        np.bitwise_or.at(bits[k], at >> 6, _U(1) << (at & 63).astype(_U))
    return bits


def _width(size: int, per_shingle: int, most: int) -> int:
    return min(most, max(64, 1 << math.ceil(math.log2(max(size * per_shingle, 1)))))


def _folded(row: np.ndarray, words_: int) -> np.ndarray:
    """A bitmap as it would be with fewer bits."""
    return np.bitwise_or.reduce(row.reshape(-1, words_), axis=0)


_SETS = "doc_id long, h long, n long, d1 long, d2 long, bits binary"


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """Size, digest and bitmap of the shingle set of every document."""
    def run(batches):
        for rows in batches:
            data, offsets = utf8(rows.column("text"))
            for i, j in groups(offsets):
                grams, first = shingle_sets(data, offsets[i : j + 1], n)
                packed = []
                for a, b in zip(first[:-1], first[1:], strict=True):
                    packed.append(bitmaps([grams[a:b]], _width(b - a, 2, MAX_BITS)).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").slice(i, j - i), rows.column("h").slice(i, j - i),
                     pa.array(np.diff(first)), *(pa.array(d.view(np.int64)) for d in _digests(grams, first)),
                     pa.array(packed, pa.binary())],
                    ["doc_id", "h", "n", "d1", "d2", "bits"],
                )

    return docs.select("doc_id", "h", "text").mapInArrow(run, _SETS)


def _posts(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Tile keys of every text by its hash; of equal sets in a batch only those of the first."""
    schemes = bands(percent)

    def run(batches):
        for rows in batches:
            data, offsets = utf8(rows.column("text"))
            ids = rows.column("h").to_numpy(zero_copy_only=False)
            met: set[tuple[int, int]] = set()
            for i, j in groups(offsets):
                grams, first = shingle_sets(data, offsets[i : j + 1], n)
                keys, sizes = [np.empty(0, _U)], np.zeros(j - i, np.int64)
                pairs = zip(*(d.tolist() for d in _digests(grams, first)), strict=True)
                for k, pair in enumerate(pairs):
                    a, b = first[k], first[k + 1]
                    if a < b and pair not in met:
                        met.add(pair)
                        keys.append(part_keys(grams[a:b], schemes, percent))
                        sizes[k] = len(keys[-1])
                yield pa.RecordBatch.from_arrays(
                    # 48 bits of key are enough to tell tiles apart: a chance match costs a look.
                    [pa.array((np.concatenate(keys) >> _U(16)).view(np.int64)), pa.array(np.repeat(ids[i:j], sizes))],
                    ["key", "h"],
                )

    return docs.select("h", "text").mapInArrow(run, "key long, h long")


def _shared(posts: DataFrame) -> DataFrame:
    """Posts of the keys that several texts have, told while reading them in the order of the keys.

    A text is known by its hash, as rows that repeat an id may differ; its copies in a tile are one post.
    """
    def run(batches):
        last = None  # the post that came last, and whether it was passed on
        for rows in batches:
            key, doc = (rows.column(c).to_numpy() for c in ("key", "h"))
            if not len(key):
                continue
            if last is not None:
                key, doc = np.append(last[0], key), np.append(last[1], doc)
            n = len(key)
            new = np.ones(n, bool)
            new[1:] = key[1:] != key[:-1]
            start = np.flatnonzero(new)
            run_of = np.cumsum(new) - 1
            several = doc != doc[start][run_of]
            wide = np.zeros(len(start), bool)
            np.logical_or.at(wide, run_of[several], True)
            if last is not None and last[2]:
                wide[0] = True
            out = wide[run_of]
            if last is not None and last[2]:
                out[0] = False  # passed on before
            out[1:] &= new[1:] | (doc[1:] != doc[:-1])
            # The last post waits for what follows, unless it is passed on already.
            told = bool(wide[-1])
            if not told:
                out[start[-1] :] = False
            # Posts of the open key that equal its first text need not be kept apart.
            last = (key[-1], doc[start[-1]], told)
            yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(doc[out])], ["key", "h"])

    dealt = posts.repartition("key").sortWithinPartitions("key", "h")
    return dealt.mapInArrow(run, "key long, h long")


def _digests(grams: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set."""
    out = []
    for salt in (EXACT[17], EXACT[19]):
        run = np.zeros(len(grams) + 1, _U)
        np.cumsum(mix(grams ^ salt), out=run[1:])
        out.append(run[first[1:]] - run[first[:-1]])
    return out[0], out[1]


def _arrays(docs: DataFrame, n: int) -> DataFrame:
    """The shingle sets themselves, as little-endian 64-bit integers."""
    def run(batches):
        for rows in batches:
            data, offsets = utf8(rows.column("text"))
            for i, j in groups(offsets):
                grams, first = shingle_sets(data, offsets[i : j + 1], n)
                packed = [grams[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(d.view(np.int64)) for d in _digests(grams, first)),
                     pa.array(np.diff(first)), pa.array(packed, pa.binary())],
                    ["d1", "d2", "n", "grams"],
                )

    return docs.select("text").mapInArrow(run, "d1 long, d2 long, n long, grams binary")


def forest(
    sets: list[np.ndarray] | None, size: np.ndarray, bits: np.ndarray, side: np.ndarray | None, percent: int
) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets, or between those of side 0 and of side 1.

    Without the sets themselves, of the pairs whose bitmaps do not rule a link out.
    """
    order = np.argsort(size, kind="stable")
    size, bits = size[order], bits[order]
    side = None if side is None else side[order]
    group, found = np.arange(len(size)), []
    for k in range(len(size) - 1):
        reach = np.searchsorted(size, size[k] * 100 // percent, "right")
        others = np.arange(k + 1, reach)
        others = others[group[others] != group[k]]
        if side is not None:
            others = others[side[others] != side[k]]
        if not len(others):
            continue
        need = -(-percent * (size[k] + size[others]) // (100 + percent))
        here = np.bitwise_count(bits[k] & ~bits[others]).sum(1, dtype=np.int64)
        there = np.bitwise_count(~bits[k] & bits[others]).sum(1, dtype=np.int64)
        bound = np.minimum(size[k] - here, size[others] - there)
        for y, least in zip(others[bound >= need], need[bound >= need], strict=True):
            if group[y] == group[k]:
                continue
            if sets is not None:
                x, z = sets[order[k]], sets[order[y]]
                if len(np.intersect1d(x, z, assume_unique=True)) < least:
                    continue
            group[group == group[y]] = group[k]
            found.append((int(order[k]), int(order[y])))
    return found


def _blocked(members: DataFrame, key: str) -> DataFrame:
    """Members by pairs of blocks: ``left``, ``right`` and the block of each.

    ``members`` has ``key``, ``node`` and ``bytes``. Blocks are cut by a hash of the node, so that
    none has many more than ``BLOCK_SETS`` members or ``BLOCK_BYTES`` bytes.
    """
    size = members.groupBy(key).agg(F.count("*").alias("m"), F.sum("bytes").alias("b")).select(
        key, F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("b") / BLOCK_BYTES), F.lit(1))
        .cast("int").alias("blocks"),
    )
    return (
        split_join(members, size, key)
        .withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            key, "node", "block",
            F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"),
        )
    )


def _compared(members: DataFrame, key: str, percent: int, exact: bool) -> DataFrame:
    """Edges found by comparing the members of each pair of blocks."""
    def run(rows: pa.Table) -> pa.Table:
        size = rows.column("n").to_numpy()
        left, right = rows.column("left")[0].as_py(), rows.column("right")[0].as_py()
        side = None if left == right else (rows.column("block").to_numpy() == right).astype(int)
        if exact:
            sets = [np.frombuffer(x.as_buffer(), _U) for x in rows.column("grams")]
            bits = bitmaps(sets, _width(int(size.max()), 8, 1 << 18))
        else:
            sets, own = None, [np.frombuffer(x.as_buffer(), _U) for x in rows.column("bits")]
            least = min(map(len, own))
            bits = np.stack([_folded(x, least) for x in own])
        pairs = forest(sets, size, bits, side, percent)
        a, b = ([p[k] for p in pairs] for k in (0, 1))
        node = rows.column("node")
        return pa.table({"a": node.take(pa.array(a, pa.int64())), "b": node.take(pa.array(b, pa.int64()))})

    return members.groupBy(key, "left", "right").applyInArrow(run, "a string, b string")


def _node():
    return F.concat(F.lpad(F.hex("d1"), 16, "0"), F.lpad(F.hex("d2"), 16, "0"))


def _links(docs: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """Links between different sets, enough of them to connect whatever is linked."""
    shared = staged(_shared(_posts(docs, n, percent)), "shared")
    held = sets.filter("n > 0").withColumn("node", _node())
    tiles = staged(shared.join(held.select("h", "node").distinct(), "h").select("key", "node").distinct(), "tiles")
    # Of the tiles with equal members one is enough.
    shape = tiles.groupBy("key").agg(
        F.count("*").alias("m"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s1"),
        F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")).alias("s2"),
    ).filter("m > 1")
    chosen = shape.groupBy("m", "s1", "s2").agg(F.min("key").alias("key")).select("key")
    needed = tiles.select("node").distinct()
    one = F.min(F.struct("doc_id", "h", "n", "bits")).alias("one")
    classes = staged(
        split_join(held, needed, "node", "left_semi").groupBy("node").agg(one).select("node", "one.*"),
        "classes",
    )
    wide = tiles.join(chosen, "key").join(classes.select("node", F.octet_length("bits").alias("bytes")), "node")
    blocks = _blocked(wide.select("key", "node", "bytes"), "key")
    maybe = _compared(
        blocks.join(classes.select("node", "n", "bits"), "node"), "key", percent, exact=False
    )
    grouped = staged(components(maybe), "groups")
    ids = classes.join(grouped.select("node"), "node").select("doc_id", "h").distinct()
    arrays = staged(
        _arrays(docs.join(ids, ["doc_id", "h"]), n).withColumn("node", _node())
        .join(grouped, "node").select("node", "label", "n", "grams"),
        "arrays",
    )
    sized = arrays.select("label", "node", F.octet_length("grams").alias("bytes"))
    blocks = _blocked(sized, "label").join(arrays.select("node", "n", "grams"), "node")
    return _compared(blocks, "label", percent, exact=True)


def _labelled(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Documents with the label of their component, and those that link with nothing."""
    docs = text_rows(docs, F.col("doc_id").cast("long")).withColumn("h", F.xxhash64("text"))
    sets = staged(_sets(docs, n), "sets")
    known = sets.filter("doc_id is not null")
    edges = _links(docs.filter("doc_id is not null"), known, n, percent)
    labels = staged(components(edges), "labels")
    rows = known.filter("n > 0").withColumn("node", _node()).join(labels, "node", "left").select(
        "doc_id", "h", "n", F.coalesce("label", "node").alias("label")
    )
    return staged(rows, "labelled"), sets.filter("n = 0 or doc_id is null")


def linked(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (smallest linked id) of every document."""
    rows, alone = _labelled(docs, n, percent)
    least = rows.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    whole = split_join(rows, least, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return whole.unionByName(alone.select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")
    ))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, that with the smallest id; columns as they are.

    Of rows equal in id and text the one whose JSON comes first stays. Documents that link with nothing stay, each of them.
    """
    rows, _ = _labelled(docs, n, percent)
    first = rows.groupBy("label").agg(F.min(F.struct("doc_id", "h")).alias("one")).select(
        F.col("one.doc_id").alias("id1"), F.col("one.h").alias("h1")
    )
    names = docs.columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.select(F.struct(*names).alias("row"), "doc_id", F.xxhash64(text).alias("h1"),
                        (F.col("doc_id").isNotNull() & text.rlike(_WORD)).alias("linkable"))
    kept = (
        whole.filter("linkable").withColumn("id1", F.col("doc_id").cast("long"))
        .join(first, ["id1", "h1"]).groupBy("id1", "h1").agg(F.min_by("row", F.to_json("row")).alias("row"))
    )
    return kept.select("row").unionByName(whole.filter("not linkable").select("row")).select("row.*")
