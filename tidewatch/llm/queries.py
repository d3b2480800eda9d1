"""One registered query per operator, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, secret_scan, top_k
from .spark_io import read, scratch

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str) -> str:
    """Where the installed public tokenizer files are; the same place on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes that any repeated 400-byte string covers."""
    from .suffix_dedup import removal_digest

    return removal_digest(read(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose three-word shingles agree to 90 percent."""
    from .ngram_join import linked

    return linked(read(spark, sf_dir, "documents", "doc_id", "text"), n=3, percent=90)


@query
def op7_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written as shards with a keyed index, and read back by key."""
    from .token_output import documents_of, write

    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return documents_of(write(docs, scratch(spark, "ids"), vocabulary("byte_bpe_50k.json")))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of each document, by limits and by trees fitted on a bounded sample."""
    from .quality import judge, train

    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return judge(docs, train(docs, read(spark, sf_dir, "labels")))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of each document."""
    from .token_counts import token_counts

    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return token_counts(docs, vocabulary("piece_bpe_32k.model"))


@query
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the window that is most like it."""
    from .decontaminate import matches

    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return matches(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


@query
def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log-probabilities of each document."""
    from .lm_score import scores

    return scores(read(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in each document, found through a trigram index."""
    from .secret_scan import scan

    return scan(read(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE["op5_secret_scan"] = secret_scan.oracle_sql()


@query
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source weights that repeat no source more than 1.37 times."""
    from .mixing import MIXED, mix

    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mix(docs, max_repeats=1.37).select("doc_id", "source", *MIXED)


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on each page's URL, by rules and by two character models."""
    from .url_filter import judge

    return judge(read(spark, sf_dir, "pages", "page_id", "url"))


@query
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 phrases of each language whose parts hold together most."""
    return collocations.collocations(read(spark, sf_dir, "documents", "lang", "text"))


ORACLE["op11_phrase_collocations"] = collocations.oracle_sql()


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words in each document, a tenth of which are made periodic first."""
    from .periodic_runs import planted, run_digest

    return run_digest(planted(read(spark, sf_dir, "documents", "doc_id", "text")))


@query
def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors nearest by inner product to every fiftieth one."""
    return top_k.integer_top_k(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


ORACLE["op13_exact_top_k"] = top_k.oracle_sql()
