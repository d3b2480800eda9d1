"""Mixing: weights, quotas and permutations, recomputed in plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from tidewatch.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(1)
    rows = [
        (k, " ".join(["w"] * r.randrange(0, 40)), r.choice(["big"] * 12 + ["mid"] * 4 + ["few", None]), "x")
        for k in range(900)
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, epoch string").repartition(6)


def tokens(rows) -> dict:
    out = defaultdict(int)
    for r in rows:
        out[r.source] += len(WORD.findall(r.text or ""))
    return out


def test_all_used_and_no_source_repeated_too_often(corpus):
    rows = M.mix(corpus, max_repeats=1.5).collect()
    there, used = tokens(corpus.collect()), tokens(rows)
    repeats = {s: used[s] / there[s] for s in there}
    assert min(repeats.values()) == 1.0
    assert max(repeats.values()) == pytest.approx(1.5, abs=0.05)
    # Weights follow a power of the shares.
    alpha = [
        math.log(used[a] / used[b]) / math.log(there[a] / there[b]) for a, b in (("big", "mid"), ("big", "few"))
    ]
    assert alpha[0] == pytest.approx(alpha[1], abs=0.05) and 0 < alpha[0] < 1
    copies = Counter(r.doc_id for r in rows)
    assert set(copies) == set(range(900)) and set(copies.values()) <= {1, 2}
    for r in rows:
        assert r.n_tokens == len(WORD.findall(r.text))


def test_entropy_and_budget(corpus):
    there = tokens(corpus.collect())
    total = sum(there.values())
    target = 1.0
    rows = M.mix(corpus, entropy=target, budget=total // 2).collect()
    used = tokens(rows)
    share = [v / sum(used.values()) for v in used.values()]
    assert -sum(x * math.log(x) for x in share) == pytest.approx(target, abs=0.03)
    assert sum(used.values()) == pytest.approx(total // 2, rel=0.02) and sum(used.values()) <= total // 2 + 4
    again = M.mix(corpus.repartition(3), entropy=target, budget=total // 2).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))
    other = M.mix(corpus, entropy=target, budget=total // 2, seed=5).collect()
    assert {r.doc_id for r in other} != {r.doc_id for r in rows}


def test_last_epoch_takes_whole_blocks_in_order(corpus):
    rows = M.mix(corpus, max_repeats=1.5).collect()
    first = defaultdict(set)
    for r in rows:
        if r.epoch == 0:
            first[r.source, r.block].add(r.doc_id)
    last = defaultdict(list)
    for r in rows:
        if r.epoch == 1:
            last[r.source].append((r.block_order, r.block, r.doc_id))
    for source, taken in last.items():
        blocks = [b for _, b in sorted({(o, b) for o, b, _ in taken})]
        whole = [b for b in blocks if first[source, b] <= {d for _, x, d in taken if x == b}]
        assert whole[: len(blocks) - 1] == blocks[:-1]


def test_hard_documents(docs, nothing, spark):
    out = M.mixed_rows(docs, max_repeats=1.3)
    assert out.columns == docs.columns
    want = Counter(map(tuple, docs.collect()))
    got = Counter(map(tuple, out.collect()))
    assert set(got) == set(want) and all(got[k] >= want[k] for k in want)
    assert M.mix(nothing, max_repeats=1.3).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in M.mix(blank, max_repeats=2.0).collect()) == [1, 2]
    with pytest.raises(ValueError, match="entropy or"):
        M.mix(blank)
