"""Maximal periodic runs of words, found with a dictionary of basic factors.

Every power-of-two length ``L`` has a dictionary: factors of ``L`` words at each place, equal ones
under one number, built by pairing two numbers of the length before. A factor that occurs once in its
text has no number, so the dictionaries shrink as fast as repetition does.

A run whose period ``p`` has ``L <= p < 2L`` holds two equal factors ``p`` words apart. Occurrences of
a factor no more than ``L / 2`` apart follow each other at its own period: they form an arithmetic
progression, within which only that period, a shorter one, can run. So a period within twice the length is proposed
for two progressions of the same factor by the last place of the one with any of the other, and by any
of the one with the first of the other:

* where the progressions end inside the run they end ``p`` apart on one side at least;
* where the first begins before the run and the second ends after it, the run begins ``p`` before
  the second, and a first place is ``p`` away from some place of the first.

Progressions lie more than ``L / 2`` apart, so each meets four later ones at most within reach, and the
proposals of a length are linear in the text. Each is extended both ways by dictionary look-ups, and
equal stretches are one run with the smallest period proposed.

Texts are independent: there is no shuffle. Tasks look at about ``GROUP`` bytes of texts together, as
one sequence whose factors never cross a text; a longer text is a group of its own, so memory follows
the longest text (about a hundred bytes a word, more while factors repeat).

Defined results: words are ``[^\\x20\\x09-\\x0D]+``, case counts; a null or empty text has no words and
no run; rows that repeat an id are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import groups, utf8
from .spark_io import text_rows

#: Bytes of text that are looked at together, and the shortest run that counts.
GROUP, MIN_WORDS = 1 << 20, 12
_EMPTY = np.empty(0, np.int64)


class Runs(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    period: np.ndarray


class Factors:
    """The dictionaries of a sequence of numbers; ``text`` tells which text each belongs to."""

    def __init__(self, words: np.ndarray, text: np.ndarray) -> None:
        self.n = len(words)
        self.names: list[np.ndarray] = []
        self.spots: list[tuple[np.ndarray, np.ndarray]] = []
        at, key = np.arange(self.n), text * (int(words.max(initial=0)) + 1) + words
        while self._name(at, key):
            names, size = self.names[-1], 1 << (len(self.names) - 1)
            at = np.flatnonzero(names[: self.n - size] >= 0) if size < self.n else _EMPTY
            at = at[(names[at + size] >= 0) & (text[at] == text[at + size])]
            key = names[at].astype(np.int64) * (int(names.max(initial=0)) + 1) + names[at + size]

    def _name(self, at: np.ndarray, key: np.ndarray) -> bool:
        order = np.argsort(key, kind="stable")
        new = np.ones(len(key) + 1, bool)
        new[1:-1] = key[order[1:]] != key[order[:-1]]
        twice = ~(new[:-1] & new[1:])
        if not twice.any():
            return False
        name = (np.cumsum(new[:-1]) - 1)[twice]
        spot = at[order[twice]]
        dense = np.full(self.n, -1, np.int32)
        dense[spot] = name
        self.names.append(dense)
        self.spots.append((spot, name))
        return True

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of words from ``a`` and from ``b`` on that are equal; both within one text."""
        out = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.names))):
            far = np.maximum(a, b) + out < self.n
            x = self.names[k][np.where(far, a + out, 0)]
            out += ((x == self.names[k][np.where(far, b + out, 0)]) & (x >= 0) & far).astype(np.int64) << k
        return out

    def back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of words before ``a`` and before ``b`` that are equal."""
        out = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.names))):
            x, y = a - out - (1 << k), b - out - (1 << k)
            near = np.minimum(x, y) >= 0
            x = self.names[k][np.where(near, x, 0)]
            out += ((x == self.names[k][np.where(near, y, 0)]) & (x >= 0) & near).astype(np.int64) << k
        return out

    def proposals(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of places of equal factors, apart by what may be a period from ``2**k`` on."""
        size = 1 << k
        spot, name = self.spots[k]
        cut = np.ones(len(spot) + 1, bool)
        cut[1:-1] = (name[1:] != name[:-1]) | (2 * (spot[1:] - spot[:-1]) > size)
        first, last = np.flatnonzero(cut[:-1]), np.flatnonzero(cut[1:])  # of each progression
        left, right, near = [], [], np.arange(len(first))
        for step in range(1, len(first)):
            near = near[near + step < len(first)]
            far = near + step
            close = (name[first[near]] == name[first[far]]) & (spot[first[far]] - spot[last[near]] < 2 * size)
            near, far = near[close], far[close]
            if not len(near):
                break
            left += [last[near].repeat(last[far] - first[far] + 1), _each(first[near], last[near])]
            right += [_each(first[far], last[far]), first[far].repeat(last[near] - first[near] + 1)]
        if not left:
            return _EMPTY, _EMPTY
        a, b = spot[np.concatenate(left)], spot[np.concatenate(right)]
        fit = (b - a >= size) & (b - a < 2 * size)
        return a[fit], b[fit]


def _each(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers from each first to its last."""
    n = last - first + 1
    return np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)


def find_runs(words: np.ndarray, text: np.ndarray, min_words: int = MIN_WORDS) -> Runs:
    """All maximal runs of ``min_words`` words or more, and of two periods at least, by start."""
    factors = Factors(words.astype(np.int64), text.astype(np.int64))
    found = []
    for k in range(len(factors.names)):
        a, b = factors.proposals(k)
        if len(a):
            back, ahead = factors.back(a, b), factors.ahead(a, b)
            keep = (back + ahead >= b - a) & (b + ahead - a + back >= min_words)
            found.append(np.stack([a - back, b + ahead, b - a])[:, keep])
    if not found:
        return Runs(_EMPTY, _EMPTY, _EMPTY)
    start, end, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return Runs(start[order], end[order], period[order])


class _Text(NamedTuple):
    row: int
    words: list[bytes]
    start: np.ndarray  # of its runs, in words of the text
    length: np.ndarray
    period: np.ndarray
    stays: np.ndarray | None  # words that no run repeats; None for all


def _texts(rows: pa.RecordBatch, min_words: int) -> Iterator[_Text]:
    data, offsets = utf8(rows.column("text"))
    for i, j in groups(offsets, GROUP):
        words = [data[offsets[k] : offsets[k + 1]].tobytes().split() for k in range(i, j)]
        first = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        flat = pa.array([w for text in words for w in text], pa.binary()).dictionary_encode()
        text = np.repeat(np.arange(j - i), np.diff(first))
        runs = find_runs(flat.indices.to_numpy(), text, min_words)
        of = np.searchsorted(runs.start, first)
        gone = np.zeros(first[-1] + 1, np.int64)
        np.add.at(gone, runs.start + runs.period, 1)
        np.add.at(gone, runs.end, -1)
        stays = np.cumsum(gone)[:-1] == 0
        for k in range(j - i):
            at = slice(of[k], of[k + 1])
            yield _Text(
                i + k, words[k], runs.start[at] - first[k], (runs.end - runs.start)[at], runs.period[at],
                stays[first[k] : first[k + 1]] if of[k + 1] > of[k] else None,
            )


def _left(text: _Text) -> bytes:
    if text.stays is None:
        return b" ".join(text.words)
    return b" ".join([text.words[k] for k in np.flatnonzero(text.stays)])


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per run: ``doc_id``, ``start`` (word number), ``length``, ``period`` and its ``unit``.

    ``unit`` is the text of the first period. A document without runs has no row.
    """
    def run(batches):
        for rows in batches:
            out = [
                (t.row, int(s), int(n), int(p), b" ".join(t.words[s : s + p]))
                for t in _texts(rows, min_words)
                for s, n, p in zip(t.start, t.length, t.period, strict=True)
            ]
            if out:
                row, *rest = zip(*out, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                columns = [rows.column("doc_id").take(pa.array(row))] + [
                    pa.array(c, k) for c, k in zip(rest, kinds, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "period", "unit"])

    return text_rows(docs, F.col("doc_id").cast("long")).mapInArrow(
        run, "doc_id long, start long, length long, period long, unit binary"
    ).withColumn("unit", F.col("unit").cast("string"))


_LONGS = ("n_runs", "start", "length", "period", "exponent_milli")
_TEXTS = ("runs_sha256", "collapsed_sha256")


def run_digest(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per document the number of runs, the longest one, and digests of all and of the collapsed text.

    Of equally long runs the one that starts first counts, then the one of the smallest period.
    ``runs_sha256`` is over ``start,length,period`` and a line feed for each run; collapsed texts
    (see ``collapsed``) go into ``collapsed_sha256``. Further columns: ``n_words``, ``n_dropped``.
    """
    names = ["doc_id", *_LONGS, *_TEXTS, "n_words", "n_dropped"]

    def run(batches):
        for rows in batches:
            out = [_digest(t) for t in _texts(rows, min_words)]
            columns = [
                pa.array(c, pa.string() if n in _TEXTS else pa.int64())
                for n, c in zip(names[1:], zip(*out, strict=True), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *columns], names)

    schema = ", ".join(f"{n} {'string' if n in _TEXTS else 'long'}" for n in names)
    return text_rows(docs, F.col("doc_id").cast("long")).mapInArrow(
        lambda b: run(x for x in b if x.num_rows), schema
    )


def _digest(text: _Text) -> tuple:
    lines = "".join(
        f"{s},{n},{p}\n" for s, n, p in zip(text.start, text.length, text.period, strict=True)
    )
    longest = (None,) * 4
    if len(text.start):
        k = np.lexsort((text.period, text.start, -text.length))[0]
        s, n, p = (int(x[k]) for x in (text.start, text.length, text.period))
        longest = (s, n, p, 1000 * n // p)
    dropped = 0 if text.stays is None else int((~text.stays).sum())
    return (
        len(text.start), *longest, hashlib.sha256(lines.encode()).hexdigest(),
        hashlib.sha256(_left(text)).hexdigest(), len(text.words), dropped,
    )


def collapsed(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id`` and ``text`` with each run cut to its first period, words joined by one space."""
    def run(batches):
        for rows in batches:
            texts = pa.array([_left(t) for t in _texts(rows, min_words)], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), texts], ["doc_id", "text"])

    return text_rows(docs, F.col("doc_id").cast("long")).mapInArrow(
        lambda b: run(x for x in b if x.num_rows), "doc_id long, text binary"
    ).withColumn("text", F.col("text").cast("string"))


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; a tenth of the documents turn periodic from some word on.

    With ``h`` the CRC-32 of the id and ``g`` a tenth of it, a document of ``n`` words with ``h % 10 = 0``
    repeats from word ``a = g % n`` on the ``1 + (n - a) / (3 + g % 8)`` words there. Rows without an
    id stay as they are.
    """
    rows = text_rows(docs, F.col("doc_id").cast("long"))
    chosen: Column = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    some = rows.filter(chosen).select(
        "*", F.floor(F.crc32(F.col("doc_id").cast("string")) / 10).alias("g"),
        F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)").alias("w"),
    ).select("*", F.expr("if(size(w) = 0, 0L, g % size(w))").alias("a"))
    text = F.expr("""array_join(transform(w, (x, i) -> if(i < a, x,
        w[cast(a + (i - a) % (1 + (size(w) - a) div (3 + g % 8)) as int)])), ' ')""")
    return rows.filter(~chosen).unionByName(some.select("doc_id", text.alias("text")))
