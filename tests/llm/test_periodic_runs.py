"""Periodic runs against trying every period at every place."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tidewatch.llm import periodic_runs as P


def brute(w, least=12):
    """Maximal stretches per period; of equal stretches the smallest period."""
    n, best = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j - i >= p and j + p - i >= least:
                best.setdefault((i, j + p), p)
            i = j
    return sorted((s, e - s, p) for (s, e), p in best.items())


def found(w, least=12):
    r = P.find_runs(np.array(w, np.int64), np.zeros(len(w), np.int64), least)
    return [(int(s), int(e - s), int(p)) for s, e, p in zip(*r, strict=True)]


def test_all_short_sequences():
    for n in range(1, 12):
        for w in itertools.product((0, 1), repeat=n):
            assert found(w, 2) == brute(w, 2), w
    for w in itertools.product((0, 1, 2), repeat=8):
        assert found(w, 2) == brute(w, 2), w


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("seed", range(12))
def test_random_sequences(seed):
    r = random.Random(seed)
    for _ in range(60):
        w = []
        while len(w) < r.randrange(1, 160):
            unit = [r.randrange(r.choice((2, 3, 9))) for _ in range(r.randrange(1, 14))]
            w += (unit * r.randrange(1, 9))[r.randrange(len(unit)) :][: r.randrange(1, 70)]
        assert found(w, 2) == brute(w, 2)


def test_shifted_progressions():
    """Two progressions that differ by a phase: every period of one residue runs at their border."""
    for unit, shift in (("ab", 1), ("abc", 1), ("abc", 2), ("aab", 1), ("abcd", 3), ("aabaa", 2)):
        for n, m in ((30, 30), (31, 17), (8, 40)):
            w = [ord(x) for x in (unit * n)[:n] + ((unit * m)[shift:] + unit * 2)[:m]]
            assert found(w, 2) == brute(w, 2)
    w = fibonacci(400)
    assert found(w, 2) == brute(w, 2)
    w = [(i & -i).bit_length() for i in range(1, 300)] + [1] * 300
    assert found(w, 2) == brute(w, 2)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plant(doc_id, w):
    if doc_id is None:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def digest(w):
    runs = brute(w)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    text = " ".join(x for i, x in enumerate(w) if i not in gone)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (
        len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4),
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), text,
    )


def test_documents(spark, docs, hard):
    """Hard texts and made-up ones, with and without planting; digests follow from the runs."""
    r = random.Random(3)
    rows = [(i, t) for i, t in hard if t is None or len(t) < 40_000]
    for i in range(200, 330):
        unit = [r.choice("abcd") for _ in range(r.randrange(1, 9))]
        rows.append((i, "lead " + "\n ".join(unit * r.randrange(1, 12)) + "\t" + " ".join(unit[: r.randrange(4)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    for plain in (True, False):
        source = df if plain else P.planted(df)
        got = P.run_digest(source).join(P.collapsed(source).select("doc_id", "text").distinct(), "doc_id").collect()
        mine = {(x.doc_id, x.n_runs, x.start, x.length, x.period, x.exponent_milli, x.runs_sha256, x.collapsed_sha256) for x in P.run_digest(source).collect()}
        want = {(i, *digest(words(t) if plain else plant(i, words(t)))[:-1]) for i, t in rows}
        assert sorted(mine, key=str) == sorted(want, key=str)
        ids = [i for i, _ in rows]
        for x in got:
            if ids.count(x.doc_id) == 1:
                t = dict(rows)[x.doc_id]
                assert x.text == digest(words(t) if plain else plant(x.doc_id, words(t)))[-1]
    assert key((None, 1)) < key((0, 1))
    runs = {(x.doc_id, x.start, x.length, x.period, x.unit) for x in P.periodic_runs(df).collect()}
    assert runs == {
        (i, s, n, p, " ".join(words(t)[s : s + p])) for i, t in rows for s, n, p in brute(words(t))
    }


def test_one_row_per_row_and_long_texts(spark, docs, hard, nothing):
    """Every row has a result, repeated ones too; texts over a megabyte are seen whole."""
    assert P.run_digest(docs).count() == len(hard) == P.collapsed(docs).count()
    assert P.run_digest(nothing).collect() == [] and P.periodic_runs(nothing).collect() == []
    unit = " ".join(f"w{i}" for i in range(90_000))
    rows = [(1, f"x {unit} {unit} y"), (2, "a " * 700_000)]
    got = {x.doc_id: x for x in P.run_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_runs, got[1].start, got[1].length, got[1].period, got[1].exponent_milli) == (1, 1, 180_000, 90_000, 2000)
    assert (got[2].n_runs, got[2].length, got[2].period, got[2].n_dropped) == (1, 700_000, 1, 699_999)
