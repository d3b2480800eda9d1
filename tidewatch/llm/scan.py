"""Vectorised reading of text columns inside Arrow batches.

Tasks see a batch of rows; the helpers here look at the bytes of its texts as one numpy array and
work on groups of rows of about a megabyte, so that memory follows the longest text, not the batch.
A null text is an empty text. Words are ``[^\\x20\\x09-\\x0D]+``; where asked for, A-Z is lowered.
Keys are 64-bit polynomial hashes of the bytes over a table of random values, finished by a mixer.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER, _DOWN = _powers(_BASE, CHUNK + 1), _powers(_INVERSE, CHUNK + 1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
EXACT = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=_U) | _U(1)
#: A-Z counts as a-z.
LOWER = EXACT.copy()
LOWER[65:91] = EXACT[97:123]
#: As LOWER, and trailing ASCII characters that are no letters do not count.
LETTERS = LOWER.copy()
LETTERS[[c for c in range(128) if not chr(c).isalpha()]] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 bits of the result."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins, with the end of the last."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, where, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data or b"", np.uint8), offsets


def groups(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``size`` bytes together; a longer text is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), i + 65536, n)
        yield i, j
        i = j


def segment_keys(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = EXACT,
    sized: bool = True,
) -> np.ndarray:
    """64-bit keys of sorted disjoint byte ranges, computed a megabyte at a time."""
    out = np.zeros(len(starts), _U)
    if not len(starts):
        return out
    lo, hi = int(starts[0]), int(ends[-1])
    for p in range(lo, hi, CHUNK):
        q = min(hi, p + CHUNK)
        i, j = np.searchsorted(ends, p, "right"), np.searchsorted(starts, q, "left")
        if i >= j:
            continue
        run = np.zeros(q - p + 1, _U)
        np.cumsum(table[data[p:q]] * _POWER[: q - p], out=run[1:])
        s, e = np.maximum(starts[i:j], p) - p, np.minimum(ends[i:j], q) - p
        part = (run[e] - run[s]) * _DOWN[s]
        if starts[i] < p:
            part[:1] *= _U(pow(_BASE, p - int(starts[i]), 1 << 64))
        out[i:j] += part
    if sized:
        out ^= (ends - starts).astype(_U) * _U(0xA24BAED4963EE407)
    return mix(out)


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # first word of each text, and the number of words
    doc: np.ndarray  # text of each word


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of consecutive texts; positions are those in ``data``."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    space = SPACE[data[lo:hi]]
    inside = ~space
    opens, closes = inside.copy(), inside.copy()
    if len(space):
        opens[1:] &= space[:-1]
        closes[:-1] &= space[1:]
        own = offsets[(offsets > lo) & (offsets < hi)] - lo
        opens[own] = inside[own]
        closes[own - 1] = inside[own - 1]
    start, end = np.flatnonzero(opens) + lo, np.flatnonzero(closes) + lo + 1
    first = np.searchsorted(start, offsets, "left")
    return Words(start, end, first, np.repeat(np.arange(len(offsets) - 1), np.diff(first)))


def windows(keys: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of ``n`` words in a row within a text, and the word at which each begins."""
    count = len(keys) - n + 1
    if count <= 0:
        return np.empty(0, _U), np.empty(0, np.int64)
    out = keys[:count].copy()
    for k in range(1, n):
        out *= _U(_BASE)
        out += keys[k : count + k]
    at = np.flatnonzero(doc[:count] == doc[n - 1 :])
    return mix(out[at] ^ _U(n)), at


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` between consecutive ``bounds``, which start at 0."""
    if len(bounds) == 2:
        return np.array([flags.sum()], np.int64)
    run = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=run[1:])
    return run[bounds[1:]] - run[bounds[:-1]]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key occurs more than once, and whether it has occurred before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice, again = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = again[order[1:][same]] = True
    return twice, again


def salted(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that differ between texts."""
    return mix(keys + (doc.astype(_U) + _U(1)) * _U(0xC2B2AE3D27D4EB4F))
