"""A pipeline over documents: quality, exact and near copies, the mix of sources, and tokens."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import bpe, exact_dedup, kneser_ney, mixing, simhash
from codeloom.llm.common import shared_dir

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; it is trained on the labelled ones.

    Null and empty texts are rejected. A language without trusted text, null included, keeps its documents. Rows that
    repeat are kept or rejected alike; null ids have no label. No documents give none. Columns are those of docs.
    """
    return kneser_ney.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space: the longest, then the one of least id, null last.

    Null texts count as empty. Of rows that repeat one stays. No documents give none. Columns are those of docs.
    """
    return exact_dedup.kept(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one of least id, null last.

    A null or empty text is a class of its own, so it stays. Of rows that repeat one stays. No documents give none.
    Columns are those of docs.
    """
    return simhash.kept(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last one of a source cut after the words that are taken of it.

    A null source is a source, the last one. Documents without words are not taken. Ids may be null or repeated: rows are
    told apart by a number. No documents give none. Columns are those of docs.
    """
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document, encoded and decoded again: a row for each row. Null counts as empty. No documents give no rows."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("tokens", tokens)]

#: SQL cannot express the language model or the SimHash recursion.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/codeloom/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
