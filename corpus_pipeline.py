"""From raw documents to packed sequences: STAGES in order, each on what its predecessor wrote.

Every stage but the last gives back the columns of documents. n_chars, where there is
such a column, follows the text.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import lines, packing, quality, secrets, simhash
from palimpsest.llm.work import discard, durable, settled

ORACLE_SQL = None  # near duplicates and packing are beyond SQL


def _sized(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps. Labels are those of the table; null texts count as empty."""
    return quality.keep_good(docs, quality.good_labels(spark, sf_dir))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later occurrences of lines that many sources share."""
    return _sized(lines.dedup_lines(docs).select(*[F.col(f"`{c}`") for c in docs.columns]))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word-shingle similarity 0.8, the smallest id."""
    return simhash.drop_near_duplicates(docs, words=5, similarity=0.8)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; a null text stays null."""
    return _sized(secrets.mask_secrets(docs))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence of at most 2048 tokens and its place there.
    A null text is an empty one: its closing id alone."""
    pieces = durable(packing.tokenize_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False), "pieces")
    return packing.best_fit_pack(pieces, packing.Capacity(tokens=2048, documents=2048, attention=2048 * 2048))


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_dup_stage),
    ("secret_scan", secret_stage),
    ("best_fit_packing", pack_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written once, and what the stage before wrote goes."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = settled(partial(stage, spark, docs, sf_dir), name)
        discard(*before)
        before = [docs]
    return docs
