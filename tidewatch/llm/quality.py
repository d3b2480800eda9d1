"""Quality rules: hard limits, then boosted trees over statistics of each document.

The trees are fitted on a bounded sample of labelled documents (``SAMPLE`` rows, those whose ids
hash lowest); everything else sees all rows and whole texts. A document is good if its label says
quality 1 and not toxic. For the trees, the words that mark bad ones in each half of the sample are those
learned from the other half; the trees see all of it. Scoring is one pass over the documents without a shuffle.

Defined results: a null or empty text has no words and fails the base rule; a null id stays a row
with a null id; repeated rows are judged each; without usable labels only the base rule decides.
Other columns of the inputs are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boost
from .scan import (
    LETTERS,
    SPACE,
    groups,
    per_text,
    repeated,
    salted,
    segment_keys,
    utf8,
    windows,
    words,
)
from .spark_io import drop, staged, text_rows

#: Most labelled rows that are looked at, and most words kept as marks of bad documents.
SAMPLE, MARKS = 8192, 512
#: Smallest probability of being good for which a document stays.
STAY = 0.5
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_CODE_POINT = ~SPACE
_CODE_POINT[0x80:0xC0] = False
_UPPER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = _DIGIT[48:58] = _MARK[list(b"!?.,;:|-")] = True

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics and the direction in which each may move the score: -1 for "more is worse".
FEATURES = {
    "marks": -1, "strongest_mark": -1, "repeated": -1, "duplicate_lines": -1, "symbols": -1,
    "upper": 0, "digits": 0, "punctuation": 0, "word_length": 0, "distinct": 0, "log_words": 0,
    "words_per_line": 0,
}
SIGNS = np.array(list(FEATURES.values()))


class Model(NamedTuple):
    """Sorted keys of marking words with their weights, and the trees."""

    keys: np.ndarray
    weights: np.ndarray
    trees: boost.Trees | None

    def keep(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.ones(len(x), bool)
        return self.trees.score(x) >= np.log(STAY / (1 - STAY))


EMPTY = Model(np.empty(0, np.uint64), np.empty(0), None)


def statistics(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[dict, np.ndarray]:
    """Base counts and features of consecutive texts."""
    lo, hi, n = int(offsets[0]), int(offsets[-1]), len(offsets) - 1
    w = words(data, offsets)
    keys = segment_keys(data, w.start, w.end)
    body, bounds = data[lo:hi], offsets - lo
    count = lambda table: per_text(table[body], bounds)
    n_words, chars, symbols = np.diff(w.first), count(_CODE_POINT), count(SYMBOLS)

    grams, at = windows(keys, w.doc, 3)
    twice, _ = repeated(salted(grams, w.doc[at]))
    covered = np.zeros(len(keys), bool)
    for k in range(3):
        covered[at[twice] + k] = True
    repeats = per_text(covered, w.first)

    inner = offsets[(offsets > lo) & (offsets < hi)]
    breaks = np.flatnonzero(body == 10) + lo
    starts = np.unique(np.concatenate([[lo], inner, breaks + 1]))
    starts = starts[starts < hi]
    ends = np.append(starts[1:], hi)[: len(starts)]
    ends = ends - (data[ends - 1] == 10) if len(ends) else ends
    held = np.searchsorted(w.start, ends, "left") > np.searchsorted(w.start, starts, "left")
    starts, ends = starts[held], ends[held]
    owner = np.searchsorted(offsets, starts, "right") - 1
    _, again = repeated(salted(segment_keys(data, starts, ends), owner))
    dups, lines = np.bincount(owner[again], minlength=n), np.bincount(owner, minlength=n)

    plain = segment_keys(data, w.start, w.end, LETTERS, sized=False)
    _, seen = repeated(salted(plain, w.doc))
    distinct = n_words - per_text(seen, w.first)
    weight = np.zeros(len(plain))
    if len(model.keys) and len(plain):
        spot = np.minimum(np.searchsorted(model.keys, plain), len(model.keys) - 1)
        weight = np.where((model.keys[spot] == plain) & ~seen, model.weights[spot], 0.0)
    strongest = np.zeros(n)
    np.maximum.at(strongest, w.doc[weight > 0], weight[weight > 0])
    total = np.bincount(w.doc, weight, n)[:n]

    per_word, per_char = np.maximum(n_words, 1), np.maximum(chars, 1)
    x = np.stack([
        total, strongest, repeats / per_word, dups / np.maximum(lines, 1), symbols / per_char,
        count(_UPPER) / per_char, count(_DIGIT) / per_char, count(_MARK) / per_char,
        chars / per_word, distinct / per_word, np.log1p(n_words), n_words / np.maximum(lines, 1),
    ], 1)
    return dict(zip(BASE, (n_words, chars, symbols, dups, repeats), strict=True)), x


def failed(base: dict) -> np.ndarray:
    n = base["n_words"]
    return (n < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEATED_PERCENT * n)


def _each(batches: Iterator[pa.RecordBatch]):
    for rows in batches:
        data, offsets = utf8(rows.column("text"))
        for i, j in groups(offsets):
            yield rows.slice(i, j - i), data, offsets[i : j + 1]


def _features(docs: DataFrame, model: Model) -> DataFrame:
    def run(batches):
        for rows, data, offsets in _each(batches):
            _, x = statistics(data, offsets, model)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in x.T] + [rows.column("good")], [*FEATURES, "good"]
            )

    return docs.mapInArrow(run, ", ".join(f"{c} double" for c in FEATURES) + ", good int")


def _marks(docs: DataFrame) -> DataFrame:
    """Words by the number of good and of bad documents that have them."""

    def run(batches):
        for rows, data, offsets in _each(batches):
            w = words(data, offsets)
            plain = segment_keys(data, w.start, w.end, LETTERS, sized=False)
            _, seen = repeated(salted(plain, w.doc))
            good = rows.column("good").to_numpy(zero_copy_only=False)[w.doc[~seen]]
            key, where = np.unique(plain[~seen], return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key.view(np.int64)),
                    pa.array(np.bincount(where, good, len(key)).astype(np.int64)),
                    pa.array(np.bincount(where, 1 - good, len(key)).astype(np.int64)),
                ],
                ["key", "good", "bad"],
            )

    return docs.mapInArrow(run, "key long, good long, bad long").groupBy("key").agg(
        F.sum("good").alias("good"), F.sum("bad").alias("bad")
    )


def _marked(rows: DataFrame) -> Model | None:
    """Marks of bad documents, learned from the rows; nothing where all are good or none is."""
    n_good, n = rows.agg(F.sum("good"), F.count("*")).first()
    if not n or n_good in (0, n):
        return None
    odds = F.log((F.col("bad") + 0.5) / (n - n_good + 1) / ((F.col("good") + 0.5) / (n_good + 1)))
    found = (
        _marks(rows).filter("bad >= 3").withColumn("odds", odds)
        .filter("odds > 2").orderBy(F.desc("odds"), F.desc("bad"), "key").limit(MARKS)
        .select("key", "odds").toPandas()
    )
    keys = found["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return Model(keys[order], found["odds"].to_numpy(float)[order], None)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows: the distinct labels whose ids hash lowest.

    Of rows that repeat an id, the text with the smallest hash stands for the label.
    """
    picked = (
        labels.select("doc_id", "quality", "toxic").dropna().distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "toxic").limit(sample)
        .select(
            "doc_id", "quality", "toxic",
            ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good"),
            (F.xxhash64(F.col("doc_id"), F.lit("half")) % 2 == 0).alias("first"),
        )
    )
    rows = staged(
        text_rows(docs, "doc_id").join(picked, "doc_id")
        .groupBy("doc_id", "quality", "toxic", "good", "first")
        .agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
        .select("one.text", "good", "first"),
        "labelled",
    )
    try:
        model = _marked(rows)
        if model is None:
            return EMPTY
        parts = []
        for fold in ("first", "not first"):
            learned = _marked(rows.filter(fold))
            other = rows.filter(f"not ({fold})")
            parts.append(_features(other, learned or model).toPandas())
    finally:
        drop(rows)
    x = pd.concat(parts)
    y = x.pop("good").to_numpy(float)
    if not len(y) or y.min() == y.max():
        return EMPTY
    return model._replace(trees=boost.fit(x.to_numpy(float), y, SIGNS))


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """Counts and verdict of every document: ``doc_id``, the base counts, both verdicts, score."""
    def run(batches):
        for rows, data, offsets in _each(batches):
            base, x = statistics(data, offsets, model)
            bad = failed(base)
            score = model.trees.score(x) if model.trees is not None else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id")]
                + [pa.array(base[c].astype(np.int64)) for c in BASE]
                + [pa.array(bad), pa.array(~bad & model.keep(x)), pa.array(score)],
                ["doc_id", *BASE, "base_failed", "kept", "score"],
            )

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE)
    return text_rows(docs, F.col("doc_id").cast("long")).mapInArrow(
        run, schema + ", base_failed boolean, kept boolean, score double"
    )


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents whose verdict is ``kept``, with their columns as they are."""
    model, names = train(docs, labels, sample), docs.columns
    whole = docs.select(F.struct(*names).alias("row"))

    def run(batches):
        for rows in batches:
            inner = rows.column("row")
            data, offsets = utf8(inner.field(inner.type.get_field_index("text")))
            for i, j in groups(offsets):
                base, x = statistics(data, offsets[i : j + 1], model)
                good = ~failed(base) & model.keep(x)
                yield pa.RecordBatch.from_struct_array(inner.slice(i, j - i).filter(pa.array(good)))

    return whole.mapInArrow(run, docs.schema)
