"""Linked documents against comparing all pairs."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import graph
from tidewatch.llm import ngram_join as J
from tidewatch.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, n: int) -> frozenset:
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, n, percent) -> list[tuple]:
    sets = [shingles(t, n) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    named = [k for k, (i, _) in enumerate(rows) if i is not None and sets[k]]
    for a in named:
        for b in named:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                group[find(a)] = find(b)
    least: dict[int, int] = {}
    for k in named:
        least[find(k)] = min(least.get(find(k), rows[k][0]), rows[k][0])
    return [
        (i, len(sets[k]), least[find(k)] if k in named else i) for k, (i, _) in enumerate(rows)
    ]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_hard_documents(docs, hard, n, percent):
    rows = [(i, t) for i, t in hard if i not in (20, 21)]
    few = docs.filter("doc_id is null or doc_id not in (20, 21)")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in J.linked(few, n, percent).collect())
    assert got == Counter(brute(rows, n, percent))


def test_long_texts(spark, hard):
    long = dict(hard)[20].split(" ")
    rows = [(0, " ".join(long)), (1, " ".join(long[:240_000])), (2, " ".join(long[:200_000]))]
    got = J.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(0, 0), (1, 0), (2, 2)]


@pytest.mark.parametrize("seed", range(3))
def test_chains_and_edges_of_the_threshold(spark, seed):
    """Small and middle sizes, where one shingle decides, and chains of near copies."""
    r = random.Random(seed)
    rows = []
    for base in range(12):
        words = [f"b{base}w{k}" for k in range(r.choice([4, 9, 11, 12, 20, 21, 39, 60, 130]))]
        for _ in range(10):
            own = words.copy()
            for _ in range(r.randrange(3)):
                own[r.randrange(len(own))] = f"x{r.randrange(1000)}"
            if r.random() < 0.3:
                words = own
            rows.append((len(rows), " ".join(own + [f"e{k}" for k in range(r.randrange(3))])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for n, percent in ((3, 90), (1, 80), (2, 50)):
        got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in J.linked(df, n, percent).collect())
        assert got == sorted(brute(rows, n, percent))


def test_linked_sets_share_a_tile():
    """Every pair at the threshold agrees in some part, whatever its sizes."""
    rng = np.random.default_rng(5)
    for percent in (90, 80):
        schemes = J.bands(percent)
        for _ in range(400):
            a = int(rng.integers(1, 300))
            b = min(a * 100 // percent, a + int(rng.integers(0, 40)))
            need = -(-percent * (a + b) // (100 + percent))
            if need > a:
                continue
            pool = rng.integers(0, 1 << 63, a + b - need, dtype=np.uint64)
            x, y = np.sort(pool[:a]), np.sort(np.append(pool[:need], pool[a:]))
            if len(x) == len(y) == need:
                continue
            shared = set(J.part_keys(x, schemes, percent)) & set(J.part_keys(y, schemes, percent))
            assert shared, (percent, a, b, need)


def test_blocks_of_a_large_tile(spark, monkeypatch):
    """A tile cut into blocks finds the same components."""
    monkeypatch.setattr(J, "BLOCK_SETS", 4)
    words = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(40):
        own = words.copy()
        own[k * 3 % 120] = f"n{k}"
        rows.append((k, " ".join(own)))
    got = J.linked(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute(rows, 3, 90))


def test_keep_one(spark, docs, hard, nothing):
    kept = J.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns
    rows = [(i, t) for i, t in hard if i not in (20, 21)]
    want = Counter()
    for (i, t), (_, size, component) in zip(rows, brute(rows, 5, 80), strict=True):
        if i is None or not size:
            want[i, t] += 1
        elif component == i:
            want[i, t] = 1
    got = Counter((r.doc_id, r.text) for r in kept.collect() if r.doc_id not in (20, 21))
    assert got == want
    assert J.keep_one(nothing).collect() == [] and J.linked(nothing).collect() == []


@pytest.mark.parametrize("local", [1_000_000, 40])
def test_components_of_paths_and_stars(spark, monkeypatch, local):
    """In one task, and in rounds between several."""
    monkeypatch.setattr(graph, "LOCAL_EDGES", local)
    edges = [(f"{a:03}", f"{a + 1:03}") for a in range(60)] + [("900", f"{b}") for b in range(901, 990)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f"{a:03}": "000" for a in range(61)} | {f"{b}": "900" for b in range(900, 990)}
    assert components(spark.createDataFrame([], "a string, b string")).collect() == []


def test_near_copies_under_one_id(spark):
    """Texts that differ link although no other id is in their tiles."""
    words = [f"w{k}" for k in range(120)]
    near = [*words[:60], "edited", *words[61:]]
    other = [f"o{k}" for k in range(120)]
    rows = [(7, " ".join(words)), (7, " ".join(near)), (8, " ".join(other)), (8, "apart from the others it is")]
    kept = J.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert sorted(r.doc_id for r in kept) == [7, 8, 8]


def test_rows_equal_in_id_and_text_have_one_result(spark):
    """Whatever order they come in, the same one stays."""
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, {"k": i % 3}, f"x{i}") for i in range(12)] + [(2, text, None, "y"), (3, "apart from it", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,long>, extra string")
    kept = [
        sorted(str(r) for r in J.keep_one(df.orderBy(F.xxhash64("extra", F.lit(seed))).repartition(1 + seed)).collect())
        for seed in range(4)
    ]
    assert kept[0] == kept[1] == kept[2] == kept[3] and len(kept[0]) == 2
