"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

A text is cut where its content says so. Chunks are deduplicated to identifiers, and it is
verified, byte for byte, that no identifier stands for two contents. From there on a text is
its ordered list of identifiers; equal lists are equal texts, so long texts move once at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, one_by_one, rows_with_keys, staged

#: A chunk ends after 256 characters or more at a line end or at punctuation with white space; without one, at 2304.
CHUNK = r"(?s).{256,2047}?(?:\n|[.!?;:,]\s)|.{1,2304}"


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def identifier(chunk: Column, strength: int, bits: int = 64) -> Column:
    """Strength 0: ``bits`` bits of a 64-bit hash; 1: 256 bits."""
    if strength:
        return F.unhex(F.sha2(chunk, 256))
    return F.xxhash64(chunk).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1))


def verified_strength(docs: DataFrame, bits: int = 64) -> int:
    """The first strength at which every identifier of these texts' chunks has one content."""
    for strength in (0, 1):
        parts = docs.select(F.explode(F.array_distinct(chunks(F.col("text")))).alias("chunk"))
        distinct = parts.select(identifier(F.col("chunk"), strength, bits).alias("id"), "chunk").distinct()
        clashes = distinct.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if clashes.isEmpty():
            return strength
    raise ValueError("two chunks share a 256-bit identifier")


def recipe_groups(docs: DataFrame, bits: int = 64) -> DataFrame:
    """On disk, per (recipe, doc_id, text_sha256): rows (how many agree), keep_id, group_size."""
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    strength = verified_strength(texts, bits)
    ids = F.transform(chunks(F.col("text")), lambda c: identifier(c, strength, bits))
    recipes = texts.select("doc_id", ids.alias("recipe"), F.sha2("text", 256).alias("text_sha256"))
    recipes = staged(recipes.groupBy("recipe", "doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("rows")), "recipes")
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.sum("rows").alias("group_size"))
    return join_hot(recipes, groups, "recipe")


def exact_groups(docs: DataFrame, bits: int = 64) -> DataFrame:
    """Per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts form a group; null counts as empty. The row with the largest doc_id stays; of
    repeated rows with that doc_id, one. A null doc_id stays only if its group has no other.
    An empty table gives no rows; other columns of ``docs`` are ignored.
    """
    rows = one_by_one(recipe_groups(docs, bits).drop("recipe"), "rows", "__i")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("__i") == 1)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, bits: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns, whatever their names: one of each group of equal texts.

    Which row stays, and nulls, as in exact_groups; of rows that agree in doc_id and text any
    one stays. An empty table gives no rows. Whole texts move once, to that choice.
    """
    keep = recipe_groups(docs, bits).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    name = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
    return rows_with_keys(docs, keep.select(F.concat(F.unhex("text_sha256"), F.encode(name, "UTF-8")).alias("key")))
