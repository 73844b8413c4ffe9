"""A corpus pipeline: quality rules, line dedup, n-gram Jaccard join, mixing of sources, SentencePiece."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import shared_dir
from granary.llm.line_dedup import dedup_lines
from granary.llm.mixing import mix_sources
from granary.llm.ngram_join import keep_one_of_each
from granary.llm.pieces import default_model, encode_decode
from granary.llm.quality_rules import keep_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the word rules and aren't depleted of lines of their own, without boilerplate lines; hosts are the sources.

    n_chars follows the text.
    """
    return keep_documents(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines repeated elsewhere; n_chars follows the text. Documents that lose all lines stay, empty."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return keep_one_of_each(docs).select(COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources have it, shuffled; a document's copies are equal rows."""
    return mix_sources(docs).select(COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (binary, little-endian unsigned 32-bit) of every document, and the text that they decode to."""
    return encode_decode(docs, default_model()).select("doc_id", "source", "n_tokens", "ids", "decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

#: Several stages can't be expressed in SQL; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
