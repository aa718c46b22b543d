"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, source
mixing and tokenisation, each stage on the rows that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet in the shared scratch folder and reads it back for the next.
All stages but the last return the columns of ``documents``.  What each does
with nulls, empty texts, ties and repeated rows is said in its operator.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import bpe, jaccard, lines, mixing, quality
from tidewatch.llm.common import read_table
from tidewatch.session import materialize, ship_package

VOCABULARY = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated line runs."""
    return lines.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents."""
    return jaccard.representatives(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.emit(docs, mixing.mix(docs))


def tokenisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with the digest of their decoded text."""
    return bpe.encode_checked(docs, bpe.read_vocabulary(public_tokenizers.path(VOCABULARY)))


def _shipped(stage):
    """The stage, with the package sent to the executors' Python workers first."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return stage(spark, docs, sf_dir)
    return run_stage


STAGES = [(name, _shipped(stage)) for name, stage in (
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("ngram_jaccard_join", near_duplicates),
    ("source_mixing", source_mixing), ("bpe_encode_decode", tokenisation))]

# The forest of the first stage and the tokens of the last are beyond SQL;
# tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
