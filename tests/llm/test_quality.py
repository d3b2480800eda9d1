"""Quality rules: counts by brute force, held-out accuracy, constraints, unusual inputs."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

from tidewatch.llm import boost
from tidewatch.llm import quality as Q
from tidewatch.llm.spark_io import read

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.1"


def counts(text: str | None) -> tuple:
    w = WORD.findall(text or "")
    seen, windows = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for k in range(len(w) - 2):
        if seen[tuple(w[k : k + 3])] > 1:
            windows |= {k, k + 1, k + 2}
    lines, dups = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dups += line in lines
            lines.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(w) < 50 or 100 * len(windows) > 50 * len(w)
    return len(w), sum(map(len, w)), symbols, dups, len(windows), failed


def test_counts_of_hard_documents(docs, hard):
    got = Counter((r.doc_id, *(r[c] for c in Q.BASE), r.base_failed) for r in Q.judge(docs, Q.EMPTY).collect())
    assert got == Counter((i, *counts(t)) for i, t in hard)
    assert all(r.kept != r.base_failed for r in Q.judge(docs, Q.EMPTY).collect())


def test_held_out_accuracy(spark):
    """Fitted on half of the labels, judged on the other half."""
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    model = Q.train(docs, labels.filter("doc_id % 2 = 0"))
    rows = Q.judge(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    bad = [r.kept for r in rows if not (r.quality == 1 and r.toxic == 0)]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.05


def test_unusual_labels(spark, docs, nothing):
    schema = "doc_id long, quality int, toxic int, text string, key string"
    none = spark.createDataFrame([], schema)
    assert Q.train(docs, none) is Q.EMPTY
    one_class = spark.createDataFrame([(k, 1, 0, "x", "y") for k in range(100, 120)] + [(None, 0, 1, "", "")], schema)
    assert Q.train(docs, one_class) is Q.EMPTY
    both = spark.createDataFrame(
        [(k, k % 2, None if k == 3 else 0, "x", "y") for k in (*range(25), *range(100, 130), 100)], schema
    )
    assert Q.judge(docs, Q.train(docs, both)).count() == docs.count()
    assert Q.judge(nothing, Q.EMPTY).collect() == []
    assert Q.keep_good(nothing, both).collect() == []


def test_keep_good_keeps_the_columns(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = Q.keep_good(docs, none)
    assert kept.columns == docs.columns
    want = Counter(r.doc_id for r in Q.judge(docs, Q.EMPTY).collect() if r.kept)
    assert Counter(r.doc_id for r in kept.collect()) == want


def test_trees_respect_constraints_and_fit():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = (x[:, 0] + np.sin(3 * x[:, 1]) + rng.normal(scale=0.3, size=3000) > 0).astype(float)
    trees = boost.fit(x, y, np.array([1, 0, -1]))
    assert ((trees.score(x) > 0) == y).mean() > 0.9
    for f, sign in ((0, 1), (2, -1)):
        base = np.repeat(rng.normal(size=(50, 3)), 40, axis=0)
        base[:, f] = np.tile(np.linspace(-3, 3, 40), 50)
        steps = np.diff(trees.score(base).reshape(50, 40), axis=1)
        assert (sign * steps >= -1e-12).all()
    constant = boost.fit(np.zeros((20, 2)), np.tile([0.0, 1.0], 10), np.zeros(2))
    assert np.allclose(constant.score(np.zeros((3, 2))), 0, atol=1e-6)


def test_labelled_rows_are_bounded_when_an_id_repeats(spark, monkeypatch):
    """A labelled id that many documents have counts as one row."""
    seen, features = [], Q._features

    def counted(rows, model):
        seen.append(rows.count())
        return features(rows, model)

    monkeypatch.setattr(Q, "_features", counted)
    texts = [(k, f"text {k} of some words") for k in range(40)]
    texts += [(k % 4, f"copy {n} of a hot id") for n in range(100) for k in range(4)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    Q.train(docs, labels, 30)
    assert seen and max(seen) <= 30
