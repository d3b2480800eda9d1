"""The stages one by one: columns, what goes and what stays."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__ as entry_point
from tidewatch.llm.spark_io import read, staged

SF = "/root/testdata/sf0.001"


def test_stages_hand_documents_on(spark):
    docs = read(spark, SF, "documents")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), name)
        assert docs.columns == columns
        rows = docs.collect()
        ids = Counter(r.doc_id for r in rows)
        assert set(ids) <= set(before) and all(r.text == before[r.doc_id] for r in rows)
        if name == "source_mixing":
            assert set(ids) == set(before) and max(ids.values()) <= 2
        else:
            assert max(ids.values()) == 1 and len(ids) <= len(before)
        before = {r.doc_id: r.text for r in rows}
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).orderBy("start").collect()
    assert Counter(r.doc_id for r in out) == ids
    at = 0
    for r in out:
        assert r.start == at
        at += r.n_tokens


def test_registered_once_with_the_entry():
    names = [n for n in entry_point.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry_point.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "token_id_output",
    ]


def test_clashing_columns_pass_unchanged(spark):
    """Columns by the names that stages use themselves come out of every stage as they went in."""
    names = ["tokens", "quota", "src", "left", "run", "block", "epoch", "doc_key", "n_blocks", "of", "row", "h",
             "label", "node", "good", "kept", "part", "block_order", "n_tokens", "item_id", "size"]
    docs = read(spark, SF, "documents")
    for name in names:
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    docs = docs.withColumn("m", F.create_map(F.lit("a"), F.col("doc_id")))
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), name)
        rows = docs.collect()
        assert rows and len(rows) <= 1.3 * before
        for r in rows:
            assert [r[c] for c in names] == [f"{c}{r.doc_id}" for c in names] and r.m == {"a": r.doc_id}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)


def test_stages_keep_arrow_batches_small(spark):
    """Whatever the rows of a table, executor and worker hold a few megabytes of it at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = read(spark, SF, "documents")
    wide = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("ten bytes "), 1000).alias("text"))

    def sizes(batches):
        for rows in batches:
            yield pa.RecordBatch.from_arrays([pa.array([rows.nbytes])], ["n"])

    for name, stage in corpus_pipeline.STAGES:
        spark.conf.unset(key)
        out = stage(spark, docs, SF)
        if name != "source_mixing":  # the one stage without Python
            n = [r.n for r in wide.mapInArrow(sizes, "n long").collect()]
            assert sum(n) >= 20_000_000 and max(n) < 5_000_000
        assert out.columns
    spark.conf.unset(key)
