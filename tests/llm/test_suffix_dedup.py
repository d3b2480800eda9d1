"""Repeated byte strings against counting every window."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from tidewatch.llm.suffix_dedup import remove_repeats, removal_digest


def brute(texts: list[str | None], size: int) -> list[tuple[int, list[tuple[int, int]], bytes]]:
    raw = [(t or "").encode() for t in texts]
    seen = Counter(hash(b[i : i + size]) for b in raw for i in range(len(b) - size + 1))
    out = []
    for b in raw:
        spans: list[list[int]] = []
        for i in range(len(b) - size + 1):
            if seen[hash(b[i : i + size])] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + size
                else:
                    spans.append([i, i + size])
        kept, at = b"", 0
        for a, z in spans:
            kept, at = kept + b[at:a], z
        out.append((len(b), [tuple(s) for s in spans], kept + b[at:]))
    return out


def check(df, texts, size, gram):
    got = sorted((r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in remove_repeats(df, size, gram).collect())
    assert got == sorted(brute(texts, size))


def test_hard_documents(spark, docs, hard):
    rows = [(i, t) for i, t in hard if i not in (20, 21)]
    few = docs.filter("doc_id is null or doc_id not in (20, 21)")
    check(few, [t for _, t in rows], 400, 200)
    got = Counter(
        (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in removal_digest(few).collect()
    )
    want = Counter(
        (i, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())
        for (i, _), (n, spans, kept) in zip(rows, brute([t for _, t in rows], 400), strict=True)
    )
    assert got == want


def test_texts_longer_than_a_piece(spark, hard):
    """Pieces overlap, so a repeat across their border is found, and in one text as well."""
    long = dict(hard)[20]
    rows = [(0, long), (1, "x" + long[700_000:1_300_000]), (2, "y" * 1000)]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in got[0].spans] == [(700_000, 1_300_000)]
    assert [tuple(s) for s in got[1].spans] == [(1, 600_001)]
    assert [tuple(s) for s in got[2].spans] == [(0, 1000)]


@pytest.mark.parametrize("seed", range(4))
def test_random_texts_of_few_signs(spark, seed):
    """Edits at every distance from a border, periods, and runs of one sign."""
    r = random.Random(seed)
    base = "".join(r.choice("abc") for _ in range(400))
    texts = []
    for _ in range(40):
        t = list(base[r.randrange(200) : r.randrange(200, 400)])
        for _ in range(r.randrange(3)):
            if t:
                t[r.randrange(len(t))] = r.choice("abcd")
        texts.append("".join(t) + "z" * r.randrange(60) + "xy" * r.randrange(40))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    check(df, texts, 40, 20)
    check(df, texts, 64, 8)


def test_what_is_left_of_shared_passages(spark):
    """Over 50 words in two documents: cut from 400 bytes on, shorter ones stay; the size left is told."""
    short = " ".join(f"p{k:05d}" for k in range(55))  # 384 bytes
    long = " ".join(f"q{k:06d}" for k in range(60))  # 479 bytes
    texts = [f"{'a' * 50} {short} {'b' * 50}", f"{'c' * 60} {short} {'d' * 60}", f"{'é' * 50}{long}{'f' * 50}",
             f"{'g' * 60}{long}", "h" * 399, "i" * 400 + long.upper(), None, "", "j" * 401]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in removal_digest(df).collect()}
    whole = {r.doc_id: r for r in remove_repeats(df).collect()}
    assert {i: r.n_kept for i, r in got.items()} == {i: len(r.kept) for i, r in whole.items()}
    assert [got[i].n_kept for i in range(9)] == [486, 506, 150, 60, 399, 879, 0, 0, 0]
    assert [got[i].share_removed for i in range(9)] == [0, 0, 479 / 629, 479 / 539, 0, 0, 0, 0, 1]


def test_no_documents(nothing):
    assert removal_digest(nothing).collect() == []
