"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes what the one before kept, as Parquet in the shared folder. All but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sqlassay.llm import exact, jaccard, langid, mixing, packing
from sqlassay.llm.common import discard, staged


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter, or told with less than even odds, go.

    So null and empty texts go. Equal texts stay or go alike, repeated rows too; very long ones
    are scored whole. Without any label to learn from, every document with a letter stays. An
    empty table gives an empty one; other columns, whatever their names, are kept.
    """
    return langid.known_language(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id.

    Null text counts as empty; a null doc_id stays only where its text has no other; of rows
    that agree in both one stays. An empty table gives an empty one; other columns are kept.
    """
    return exact.exact_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a shingle similarity of 0.8 or more, the one with the smallest doc_id.

    A null doc_id stays only where there is no other, and of rows that agree in doc_id and text
    one; documents without words are linked with nothing and stay. An empty table gives an
    empty one; other columns are kept.
    """
    return jaccard.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them: not at all, once or twice.

    A null source is a source, the last one; texts without words are taken as often as whole
    epochs are; repeated rows count each. An empty table gives an empty one; other columns are kept.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is the end id alone; a very long text is cut into pieces; repeated rows, as the
    mix makes them, are packed as often as they occur. An empty table gives no rows.
    """
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("pack", pack),
]

#: Learning, similarity joins, sampling by hash and packing are beyond SQL; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, staged(stage(spark, docs, sf_dir), f"stage-{name}")
        if hasattr(before, "staged_at"):
            discard(before)  # what a stage read is of no more use
    return docs
