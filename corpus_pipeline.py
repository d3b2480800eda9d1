"""From raw documents to token ids: five stages over whole tables.

Each stage takes ``(spark, docs, sf_dir)`` and returns the documents it keeps, with their columns;
the last returns where the ids of each document are. Stages hand over written tables. Those that run
Python keep the session's Arrow batches small, since executors and workers outlive a stage.

Defined results: columns that no stage asks for pass through all but the last unchanged, whatever
their names. A null text is empty: the quality rules reject it, as they do any text under 50 words. A
document without an id is never linked or dropped as a copy. Of rows equal in id and text, as of
other copies, one stays, told by the row's content where its columns differ. Rows that repeat an id
with other texts are documents of their own. Empty tables, of labels or benchmark items too, pass
through: without labels only the fixed rules reject, without items nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm.decontaminate import drop_contaminated
from tidewatch.llm.mixing import mixed_rows
from tidewatch.llm.ngram_join import keep_one
from tidewatch.llm.quality import keep_good
from tidewatch.llm.queries import vocabulary
from tidewatch.llm.spark_io import bound_batches, read, scratch, staged
from tidewatch.llm.token_output import documents_of, write

#: The mixture uses every document, and those of the smallest sources at most so often.
MAX_REPEATS = 1.25


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    bound_batches(spark)
    return keep_good(docs, read(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 80 percent."""
    bound_batches(spark)
    return keep_one(docs, n=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    bound_batches(spark)
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture has them: all at least once, small sources again."""
    return mixed_rows(docs, max_repeats=MAX_REPEATS)


def token_id_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in shards with a keyed index, read back by key."""
    bound_batches(spark)
    return documents_of(write(docs, scratch(spark, "ids"), vocabulary("byte_bpe_50k.json")))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_id_output", token_id_output),
]

#: Trained models, similarity and tokenizers have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
