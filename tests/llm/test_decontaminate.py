"""Benchmark items in documents against trying every window."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tidewatch.llm import decontaminate as D
from tidewatch.llm.scan import utf8

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(w: list[str], n: int) -> list[tuple]:
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


def brute(rows, items) -> dict[tuple, float]:
    """Best similarity of each document and item over all windows, at the threshold or above."""
    parsed = [(i, WORD.findall((t or "").translate(LOW))) for i, t in items]
    parsed = [(i, w) for i, w in parsed if w]
    own = [set(grams(w, min(5, len(w)))) for _, w in parsed]
    seen = Counter(g for s in own for g in s)
    rare = 1 + math.log(len(parsed)) if parsed else 1
    weight = lambda s: sum(rare - math.log(seen.get(g, 1)) for g in s)
    out = {}
    for k, (_, text) in enumerate(rows):
        w = WORD.findall((text or "").translate(LOW))
        for (i, words), s in zip(parsed, own, strict=True):
            n = min(5, len(words))
            best = 0.0
            for start in range(len(w) - n + 1):
                x = set(grams(w[start : start + len(words)], n))
                best = max(best, weight(x & s) / weight(x | s))
            if best >= 0.8:
                out[k, i] = best
    return out


def planted():
    r = random.Random(4)
    word = lambda: f"v{r.randrange(300)}"
    items = [(k, " ".join(word() for _ in range(r.randrange(8, 60)))) for k in range(30)]
    items += [(40, "Too short"), (41, None), (42, ""), (43, items[0][1]), (43, items[1][1].upper())]
    rows = []
    for k in range(160):
        w = [word() for _ in range(r.randrange(0, 120))]
        if k % 2:
            own = items[r.randrange(30)][1].split()
            for _ in range(r.randrange(0, 4)):
                own[r.randrange(len(own))] = "edited"
            at = r.randrange(len(w) + 1)
            w[at:at] = own
        rows.append((k, "\n".join(w).replace("v1", "V1")))
    return items, rows


def test_recall_of_near_items_and_no_false_ones(spark):
    items, rows = planted()
    rows += [(900, None), (None, items[2][1]), (901, "too short"), (902, ""), (902, items[3][1])]
    want = brute(rows, items)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in D.matches(df, bench).collect()}
    exact = {(rows[k][0], i): s for (k, i), s in want.items()}
    assert set(got) == set(exact)
    assert all(abs(s - exact[k]) < 1e-9 for k, s in got.items())
    clean = D.drop_contaminated(df, bench)
    hit = {k for k, _ in want}
    kept = Counter((r.doc_id, r.text) for r in clean.collect())
    assert kept == Counter(x for k, x in enumerate(rows) if k not in hit)


def test_blocks_of_the_benchmark_give_the_same(spark):
    items, rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    ids = lambda x: {(r.doc_id, r.item_id) for r in x.collect()}
    sizes = [len(b.ids) for b in D.blocks(bench, 2000)]
    assert len(sizes) > 2 and sum(sizes) == 33
    assert ids(D.matches(df, bench, 2000)) == {(rows[k][0], i) for k, i in brute(rows, items)}


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 500, n)) for n in [30] * 60 + [20] * 9]
    b = D.Benchmark(list(range(69)), texts)
    flips = (0, 3, D.RADIUS, D.RADIUS + 1)
    prints = np.concatenate([b.prints ^ np.uint64((1 << int(k)) - 1) for k in flips])
    assert b.lengths.tolist() == [[5, 16], [5, 26]]
    for kind, of in ((1, range(60)), (0, range(60, 69))):
        got = set(zip(*(x.tolist() for x in b.near(prints, np.full(len(prints), kind))), strict=True))
        want = {
            (w, i) for w, p in enumerate(prints) for i in of if int(p ^ b.prints[i]).bit_count() <= D.RADIUS
        }
        assert got == want


def recall(rows, items) -> dict[str, float]:
    """Share of the matches by brute force that each source of candidates finds by itself."""
    want = set(brute(rows, items))
    named = [(i, t) for i, t in items if t and WORD.search(t)]
    b = D.Benchmark([i for i, _ in named], [t for _, t in named])
    data = utf8(pa.array([t or "" for _, t in rows], pa.string()))
    got = {s: {(m.doc, b.ids[m.item]) for m in b.search(*data, (s,))} for s in D.SOURCES}
    assert all(g <= want for g in got.values())
    return {s: len(g) / len(want) for s, g in got.items()}


def test_recall_of_each_source():
    for items, rows in (planted(), edited()):
        found = recall(rows, items)
        assert found["bound"] == 1.0
        assert found["prints"] >= 0.9


def test_hard_documents_and_nothing(spark, docs, nothing):
    empty = spark.createDataFrame([], "item_id long, text string, score int")
    assert D.matches(docs, empty).collect() == []
    assert D.drop_contaminated(docs, empty).count() == docs.count()
    bench = spark.createDataFrame([(1, "one"), (None, "TWICE the same\trow")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.similarity) for r in D.matches(docs, bench).collect()}
    assert got == {(8, 1, 1.0), (9, 1, 1.0), (10, 1, 1.0), (15, None, 1.0), (17, 1, 1.0)}
    assert D.matches(nothing, bench).collect() == []
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 6


def edited():
    """Passages at and around the threshold: spread edits, equal and unequal weights, repeats."""
    r = random.Random(11)
    word = lambda: f"u{r.randrange(100_000)}"
    frame = [word() for _ in range(44)]
    items, rows = [], []
    for k in range(9):
        own = [word() for _ in range(r.randrange(13, 110))]
        if k % 3 == 1:  # most of it is the same in many items, what differs is heavy
            own = frame + own[:8]
        if k % 3 == 2:  # a shingle repeated, which an edit may replace by another repeated one
            own = own + ["again"] * 60
        items.append((k, " ".join(own)))
        for n in range(0, 10):
            w = own.copy()
            for _ in range(n // 3 if k % 3 == 0 else n // 4):
                w[r.randrange(len(w))] = word()
            if k % 3 == 2 and n % 2:
                w = [f"new{k}" if x == "again" else x for x in w]
            w = [word() for _ in range(r.randrange(30))] + w + [word() for _ in range(r.randrange(30))]
            rows.append((1000 * k + n, " ".join(w)))
    return items, rows


def test_no_match_near_the_threshold_is_lost(spark):
    items, rows = edited()
    want = {(rows[k][0], i): s for (k, i), s in brute(rows, items).items()}
    assert sum(s < 0.85 for s in want.values()) > 5
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in D.matches(df, bench).collect()}
    assert set(got) == set(want)
    assert all(abs(s - want[k]) < 1e-9 for k, s in got.items())
    kept = {r.doc_id for r in D.drop_contaminated(df, bench).collect()}
    assert kept == {k for k, _ in rows} - {k for k, _ in want}


def test_several_blocks_equal_one(spark):
    items, rows = edited()
    # Documents that hold parts of two items: what one block knows weighs in the other.
    rows += [(k, f"{rows[k][1]} {rows[-k][1]}") for k in range(1, 20)] + [rows[0], (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(list(D.blocks(bench, 800))) > 2
    get = lambda *size: sorted(
        (str(r.doc_id), r.item_id, round(r.similarity, 9), r.start_word, r.n_words)
        for r in D.matches(df, bench, *size).collect()
    )
    assert get(800) == get() != []
    kept = [Counter(D.drop_contaminated(df, bench, *size).collect()) for size in ((800,), ())]
    assert kept[0] == kept[1]
