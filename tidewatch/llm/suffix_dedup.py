"""Repeated byte strings by depth-limited radix passes over runs of suffixes.

Wanted are all places where the next ``THRESHOLD`` bytes also stand somewhere else. Sorting every
suffix would shuffle one row per byte, so suffixes travel in runs. The first digit of a suffix is
the ``GRAM``-byte string with the smallest hash among those within its first ``THRESHOLD`` bytes
(equal windows have equal smallest grams at equal distances), and consecutive suffixes that share
that gram are one run. Later digits order the members of equal groups further:

1. by the gram itself: a run whose gram occurs once holds no repeat and leaves;
2. by all bytes a run covers: equal runs are repeated throughout;
3. runs that are neither are cut into blocks of ``BLOCK`` suffixes. A block whose common core occurs
   once leaves, equal blocks are repeated throughout;
4. the suffixes of the blocks left, each by its whole ``THRESHOLD`` bytes.

Of several equal runs or blocks one goes on, for the others to be compared with.

So the groups that are equal after the last digit are exactly the repeated windows, and each pass
counts keys by partial aggregation: a group of copies of any size is never gathered. Digits are
compared by 128-bit hashes.

Defined results: a null text is empty and a text below the threshold stays whole; matches never
cross documents; rows that repeat an id are documents of their own (a document is known by a hash
of its id and text, and rows equal in both have equal results); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import CHUNK, EXACT, groups, mix, utf8
from .spark_io import drop, split_join, staged, text_rows

THRESHOLD, GRAM, BLOCK = 400, 200, 16
_U = np.uint64
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Hashes of substrings of one buffer, by prefix sums; two of them make 128 bits."""

    _up: dict = {}
    _down: dict = {}

    def __init__(self, body: np.ndarray) -> None:
        self.runs = []
        for base in _BASES:
            if len(self._up.get(base, ())) < len(body) + 1:
                self._up[base] = _powers(base, len(body) + CHUNK)
                self._down[base] = _powers(pow(base, -1, 1 << 64), len(body) + CHUNK)
        self.values = EXACT[body]
        self._run(0)

    def _run(self, which: int) -> np.ndarray:
        while len(self.runs) <= which:
            base = _BASES[len(self.runs)]
            run = np.zeros(len(self.values) + 1, _U)
            np.cumsum(self.values * self._up[base][: len(self.values)], out=run[1:])
            self.runs.append(run)
        return self.runs[which]

    def of(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0, which: int = 0):
        """Hash of each ``[start, end)``, told apart by ``salt``."""
        run = self._run(which)
        h = (run[end] - run[start]) * self._down[_BASES[which]][start]
        return mix(h ^ (np.asarray(salt).astype(_U) * _U(0xA24BAED4963EE407)))

    def grams(self, size: int) -> np.ndarray:
        run = self._run(0)
        return mix((run[size:] - run[:-size]) * self._down[_BASES[0]][: len(run) - size])


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive keys."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, ~_U(0))
    padded[: len(keys)] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _pieces(batches: Iterator[pa.RecordBatch], threshold: int):
    """Texts about a megabyte at a time: rows, their bytes, their bounds, and where those begin.

    A longer text comes in pieces that overlap by what a window needs.
    """
    for rows in batches:
        data, offsets = utf8(rows.column("text"))
        for i, j in groups(offsets):
            a, b = int(offsets[i]), int(offsets[j])
            for p in range(a, max(a + 1, b - threshold + 1), CHUNK) if j == i + 1 else (a,):
                q = min(b, p + CHUNK + threshold - 1) if j == i + 1 else b
                bounds = np.array([0, q - p]) if j == i + 1 else offsets[i : j + 1] - a
                yield rows, i, data[p:q], bounds, p - a if j == i + 1 else 0


def runs_of(h: Hashes, bounds: np.ndarray, threshold: int, gram: int):
    """Anchor, first and last suffix of each run of suffixes of consecutive texts."""
    size = int(bounds[-1])
    if size < threshold:
        return (np.empty(0, np.int64),) * 3
    keys = (h.grams(gram) & ~_U(0xFFFFFFFF)) | np.arange(size - gram + 1, dtype=_U)
    anchor = (_least(keys, threshold - gram + 1) & _U(0xFFFFFFFF)).astype(np.int64)
    long = np.diff(bounds) >= threshold
    step = np.zeros(size + 1, np.int8)
    step[bounds[:-1][long]] += 1
    step[bounds[1:][long] - threshold + 1] -= 1
    whole = np.cumsum(step[: len(anchor)], dtype=np.int8) > 0  # windows within one text
    turn = np.ones(len(anchor) + 1, bool)
    turn[1:-1] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])
    first, last = np.flatnonzero(turn[:-1] & whole), np.flatnonzero(turn[1:] & whole)
    return anchor[first], first, last


def _batched(parts: Iterator[tuple], fields: dict, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= rows:
            yield _flush(held, fields)
            held, n = [], 0
    if held:
        yield _flush(held, fields)


def _flush(held: list, fields: dict) -> pa.RecordBatch:
    columns = []
    for values, kind in zip(zip(*held, strict=True), fields.values(), strict=True):
        if isinstance(values[0], pa.Array):
            columns.append(pa.concat_arrays(values).cast(kind))
        else:
            x = np.concatenate(values)
            columns.append(pa.array(x.view(np.int64) if x.dtype == _U else x).cast(kind))
    return pa.RecordBatch.from_arrays(columns, list(fields))


def _types(fields: dict) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{c} {names[t]}" for c, t in fields.items())


_LONG, _INT = pa.int64(), pa.int32()
#: Gram, two hashes of all bytes covered, document, anchor, first and last suffix of a run.
_RUN = {"g": _LONG, "u": _LONG, "v": _LONG, "id": _LONG, "at": _INT, "lo": _INT, "hi": _INT}
_BLOCK = {"g": _LONG, "u": _LONG, "v": _LONG, "id": _LONG, "run": _INT, "at": _INT, "lo": _INT, "hi": _INT}
_CONTEXT = {"id": _LONG, "run": _INT, "at": _INT, "lo": _INT, "hi": _INT, "bytes": pa.binary()}
_WINDOW = {"u": _LONG, "v": _LONG, "id": _LONG, "lo": _INT}


def _shape(at, lo, hi, threshold):
    """A number that tells runs apart that lie differently around their anchor."""
    return (at - lo) * (threshold + 1) + (hi - at) + threshold + 1


def _runs(docs: DataFrame, threshold: int, gram: int) -> DataFrame:
    def parts(batches):
        for rows, i, body, bounds, base in _pieces(batches, threshold):
            h = Hashes(body)
            at, lo, hi = runs_of(h, bounds, threshold, gram)
            doc = np.searchsorted(bounds, lo, "right") - 1
            salt, back = _shape(at, lo, hi, threshold), base - bounds[doc]
            ids = rows.column("id").to_numpy(zero_copy_only=False)
            yield (
                h.of(at, at + gram), h.of(lo, hi + threshold, salt), h.of(lo, hi + threshold, salt, 1),
                ids[i + doc], at + back, lo + back, hi + back,
            )

    return docs.select("id", "text").mapInArrow(lambda b: _batched(parts(b), _RUN), _types(_RUN))


def _contexts(docs: DataFrame, todo: DataFrame, threshold: int) -> DataFrame:
    """The bytes that each run covers."""
    def parts(batches):
        for rows in batches:
            data, offsets = utf8(rows.column("text"))
            runs = rows.column("runs")
            doc = np.repeat(np.arange(rows.num_rows), runs.value_lengths().to_numpy(zero_copy_only=False))
            at, lo, hi = (x.to_numpy() for x in runs.flatten().flatten())
            a, size = offsets[doc] + lo, hi - lo + threshold
            stop = np.concatenate([[0], np.cumsum(size)])
            take = np.arange(stop[-1]) + np.repeat(a - stop[:-1], size)
            packed = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(lo), [None, pa.py_buffer(stop.astype(np.int64)), pa.py_buffer(data[take])]
            )
            ids = rows.column("id").to_numpy(zero_copy_only=False)
            yield ids[doc], lo, at, lo, hi, packed

    by_doc = todo.groupBy("id").agg(F.collect_list(F.struct("at", "lo", "hi")).alias("runs"))
    return docs.select("id", "text").join(by_doc, "id").mapInArrow(
        lambda b: _batched(parts(b), _CONTEXT, 4096), _types(_CONTEXT)
    )


def _blocks(contexts: DataFrame, threshold: int) -> DataFrame:
    """Runs cut into blocks of suffixes at fixed distances from their anchor."""
    def parts(batches):
        for rows in batches:
            data, offsets = utf8(rows.column("bytes"))
            ids, run, at, lo, hi = (rows.column(c).to_numpy() for c in ("id", "run", "at", "lo", "hi"))
            for i, j in groups(offsets):
                base, h = int(offsets[i]), Hashes(data[offsets[i] : offsets[j]])
                move = offsets[i:j] - base - lo[i:j]
                a, f, z = at[i:j] + move, lo[i:j] + move, hi[i:j] + move
                near, far = (a - z) // BLOCK, (a - f) // BLOCK
                n = far - near + 1
                each = np.repeat(np.arange(j - i), n)
                b = near[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                a, top = a[each], a[each] - b * BLOCK
                first, last = np.maximum(f[each], top - BLOCK + 1), np.minimum(z[each], top)
                salt, back = _shape(a, first, last, threshold), -move[each]
                # What all windows of the whole block have in common identifies it first.
                yield (
                    h.of(top, top - BLOCK + 1 + threshold, b + (1 << 20)),
                    h.of(first, last + threshold, salt), h.of(first, last + threshold, salt, 1),
                    ids[i:j][each], run[i:j][each], a + back, first + back, last + back,
                )

    return contexts.mapInArrow(lambda b: _batched(parts(b), _BLOCK), _types(_BLOCK))


def _windows(contexts: DataFrame, blocks: DataFrame, threshold: int) -> DataFrame:
    """Every suffix of the blocks, by all its bytes."""
    def parts(batches):
        for rows in batches:
            data, offsets = utf8(rows.column("bytes"))
            ids, run, lo, hi = (rows.column(c).to_numpy() for c in ("id", "run", "lo", "hi"))
            for i, j in groups(offsets):
                base, h = int(offsets[i]), Hashes(data[offsets[i] : offsets[j]])
                n = hi[i:j] - lo[i:j] + 1
                each = np.repeat(np.arange(j - i), n)
                s = lo[i:j][each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                p = s - run[i:j][each] + offsets[i:j][each] - base
                yield h.of(p, p + threshold), h.of(p, p + threshold, 0, 1), ids[i:j][each], s

    spans = blocks.select("id", "run", "lo", "hi")
    return contexts.select("id", "run", "bytes").join(spans, ["id", "run"]).mapInArrow(
        lambda b: _batched(parts(b), _WINDOW), _types(_WINDOW)
    )


def _pass(members: DataFrame, *place: str) -> tuple[DataFrame, DataFrame]:
    """One radix pass over members with a coarse digit ``g`` and a fine one ``u``, ``v``.

    Returns the members that have an equal, and of those with another of equal coarse digit that is
    not equal to them one per class, if some such class has one member.
    """
    coarse = members.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g")
    left = staged(split_join(members, coarse, "g", "left_semi"), "digit")
    classes = staged(
        left.groupBy("g", "u", "v").agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("one")),
        "classes",
    )
    mixed = (
        classes.groupBy("g").agg(F.count("*").alias("k"), F.min("n").alias("least"))
        .filter("k > 1 and least = 1").select("g")
    )
    twice = classes.filter("n > 1").select("g", "u", "v")
    equal = left.join(twice, ["g", "u", "v"], "left_semi").select(*place)
    deeper = split_join(classes, mixed, "g", "left_semi").select("one.*")
    return equal, deeper


def repeated_spans(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """Runs ``id``, ``lo``, ``hi``: every window that begins at ``lo`` to ``hi`` stands elsewhere too."""
    runs = staged(_runs(docs, threshold, gram), "runs")
    equal, deeper = _pass(runs, "id", "at", "lo", "hi")
    drop(runs)
    contexts = staged(_contexts(docs, deeper, threshold), "contexts")
    equal_blocks, blocks = _pass(_blocks(contexts, threshold), "id", "run", "at", "lo", "hi")
    windows = staged(_windows(contexts, blocks, threshold), "windows")
    twice = windows.groupBy("u", "v").agg(F.count("*").alias("n")).filter("n > 1").select("u", "v")
    single = split_join(windows, twice, ["u", "v"], "left_semi")
    return (
        equal.select("id", "lo", "hi")
        .unionByName(equal_blocks.select("id", "lo", "hi"))
        .unionByName(single.select("id", "lo", F.col("lo").alias("hi")))
    )


_OUT = {"doc_id": _LONG, "n_bytes": _LONG, "n_removed": _LONG, "n_spans": _LONG}


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """Every document without its repeated bytes.

    Returns ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` (start and end of each
    removed run of bytes) and ``kept`` (the bytes left).
    """
    return _removed(docs, threshold, gram, False)


def removal_digest(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """As ``remove_repeats``, with the SHA-256 of the bytes left in place of spans and bytes.

    ``n_kept`` (how many bytes are left) and ``share_removed`` (of an empty text 0) follow.
    """
    share = F.when(F.col("n_bytes") > 0, F.col("n_removed") / F.col("n_bytes")).otherwise(0.0)
    return _removed(docs, threshold, gram, True).select(
        "*", (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), share.alias("share_removed")
    )


def _removed(docs: DataFrame, threshold: int, gram: int, digest: bool) -> DataFrame:
    docs = text_rows(docs, F.col("doc_id").cast("long")).withColumn("id", F.xxhash64("doc_id", "text"))
    spans = (
        repeated_spans(docs, threshold, gram).groupBy("id")
        .agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    )
    last = "kept_sha256 string" if digest else "spans array<struct<start:long,end:long>>, kept binary"

    def run(batches):
        for rows in batches:
            data, offsets = utf8(rows.column("text"))
            out = []
            for k, runs in enumerate(rows.column("runs")):
                text = data[offsets[k] : offsets[k + 1]]
                begin, end = _merged(runs, threshold)
                stay = _cut(text, begin, end)
                out.append(
                    (len(text), int((end - begin).sum()), len(begin))
                    + ((hashlib.sha256(stay).hexdigest(),) if digest else (
                        [{"start": int(a), "end": int(b)} for a, b in zip(begin, end, strict=True)], stay))
                )
            columns = [pa.array(c, _LONG) for c in list(zip(*out, strict=True))[:3]]
            rest = list(zip(*out, strict=True))[3:]
            if digest:
                columns.append(pa.array(rest[0], pa.string()))
                names = [*_OUT, "kept_sha256"]
            else:
                span = pa.list_(pa.struct([("start", _LONG), ("end", _LONG)]))
                columns += [pa.array(rest[0], span), pa.array(rest[1], pa.binary())]
                names = [*_OUT, "spans", "kept"]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *columns], names)

    types = f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}"
    return docs.join(spans, "id", "left").select("doc_id", "text", "runs").mapInArrow(
        lambda b: run(x for x in b if x.num_rows), types
    )


def _merged(runs: pa.Scalar, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte runs under the windows."""
    if not runs.is_valid or not len(runs):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lo, hi = (x.to_numpy().astype(np.int64) for x in runs.values.flatten())
    order = np.argsort(lo, kind="stable")
    begin, end = lo[order], np.maximum.accumulate(hi[order] + threshold)
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    return begin[new], np.append(end[:-1][new[1:]], end[-1])


def _cut(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> bytes:
    if not len(begin):
        return text.tobytes()
    stay = zip(np.append(0, end), np.append(begin, len(text)), strict=True)
    return b"".join(text[a:b].tobytes() for a, b in stay)
