"""Mined phrases against counting every phrase of every piece, and against SQL."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from tidewatch.llm import collocations as C


def lowered(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, min_count=30, max_words=4, cover=80, top=2000):
    f: dict[str, Counter] = {}
    for lang, text in rows:
        counts = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text or "")):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            for k in range(1, max_words + 1):
                counts.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        n = sum(a for p, a in counts.items() if len(p) == 1)
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        hidden = set()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    part = p[i : i + k]
                    if 100 * a >= cover * found[part]:
                        hidden.add(part)
        shown = []
        for p, a in found.items():
            if p in hidden:
                continue
            cuts = [(2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            shown.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]], k))
        for rank, (score, a, phrase, left, right, k) in enumerate(sorted(shown)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score, k))
    return sorted(out)


def mined(df, **kw):
    return sorted(tuple(r) for r in C.collocations(df, **kw).collect())


def frame(spark, rows, parts=3):
    return spark.createDataFrame(
        [(i, lang, text, "x") for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, n string"
    ).repartition(parts)


def sample(seed: int, n: int = 60):
    r = random.Random(seed)
    vocabulary = ["Alpha", "beta", "gamma", "é", "日本", "d-e", "\x00", "x" * 40] + [f"w{i}" for i in range(12)]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(r.randrange(60)):
            parts.append(r.choice(["alpha beta gamma w1", "beta Gamma", r.choice(vocabulary), r.choice(vocabulary)]))
            parts.append(r.choice([" ", "  ", "\t", " ", " ", ", ", "\n", ".", "!?"]))
        rows.append((r.choice(["en", "en", "fr", None, ""]), "".join(parts)))
    return rows + [("en", None), ("en", ""), (None, " \t\n"), ("de", "...,,,")]


@pytest.mark.parametrize("seed", range(3))
def test_equals_counting(spark, seed):
    rows = sample(seed)
    df = frame(spark, rows)
    assert mined(df, min_count=5) == brute(rows, 5)
    assert mined(df, min_count=3, max_words=3, cover_percent=50, top=7) == brute(rows, 3, 3, 50, 7)
    assert mined(df, min_count=2, max_words=2) == brute(rows, 2, 2)


def test_blocks_that_cut_pieces(spark, monkeypatch):
    """Small blocks and slices: phrases across a cut count once, whatever the number of languages."""
    rows = sample(9, 25) + [("en", "alpha beta gamma w1 " * 200), (None, "y" * 300 + " z " + "y" * 300)]
    df = frame(spark, rows, 2)
    want = brute(rows, 4)
    for name, value in (("BLOCK_WORDS", 13), ("SLICE", 64), ("PENDING_WORDS", 50), ("ROW", 3), ("POSTS", 20), ("BLOCKS", 4)):
        monkeypatch.setattr(C, name, value)
    # The workers import the module themselves: hand them the functions as they are here.
    from pyspark import cloudpickle as pickler

    pickler.register_pickle_by_value(C)
    try:
        assert mined(df, min_count=4) == want
    finally:
        pickler.unregister_pickle_by_value(C)


def test_hot_rows(spark):
    """A third of the rows are one text of one phrase."""
    rows = sample(4, 40) + [("en", "same same, same same same same")] * 25
    assert mined(frame(spark, rows), min_count=6) == brute(rows, 6)


def test_hard_and_no_documents(docs, hard, nothing):
    rows = [("en", t) for _, t in hard if t is None or len(t) < 300_000]
    few = docs.filter("text is null or length(text) < 300000")
    assert mined(few, min_count=3, top=10**6) == brute(rows, 3, top=10**6)
    assert mined(nothing) == []


def test_large_counts_stay_exact(spark):
    """Products beyond 64 bits."""
    row = spark.sql("""
        select cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as s
        from values (9000000000000000001L, 9000000000000000002L, 9000000000000000002L) t(a, l, r)""").first()
    assert row.s == 2000000 * 9000000000000000001 // (2 * 9000000000000000002)
