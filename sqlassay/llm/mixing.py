"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame functions only).

Every document gets an exponential key -ln(u) / quality weight, with u decided by its id.
Sorted by key within its source, documents are summed up to the source's token budget.
A budget over the source's size takes whole epochs first; the fraction left is selected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, one_by_one, running_total, staged, unit_hash, whole, words_in

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2.0


def quality(text: Column) -> Column:
    """Weight from 0.1 to 1: the share of letters among a text's characters."""
    length = F.length(text)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.when(length > 0, F.lit(0.1) + F.lit(0.9) * letters / length).otherwise(F.lit(0.1))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS) -> DataFrame:
    """(source, source_size, ...) -> the same with source_no, target, epochs and budget.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all
    sizes. No target passes ``max_epochs`` times its source's size: the excess is shared
    again by weight. The end of that is one level L with target = min(cap, L * weight); with
    sources sorted by cap / weight, L is the largest of (total - caps before) / (weights not
    before). One row per source, so these windows see as many rows as there are sources.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("source_no", (F.row_number().over(in_order) - 1).cast("long")).withColumn("__w", weight)
    s = s.withColumn("__cap", F.col("source_size") * F.lit(float(max_epochs)))
    whole = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("__cap") / F.col("__w"), "source_no")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    caps = F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    s = s.withColumn("__level", (F.sum("source_size").over(whole) * F.lit(float(share)) - caps) / F.sum("__w").over(after))
    s = s.withColumn("target", F.least("__cap", F.max("__level").over(whole) * F.col("__w")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    s = s.withColumn("epochs", F.floor(ratio + F.lit(1e-12)).cast("long"))
    s = s.withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
    return s.drop("__w", "__cap", "__level")


def mix_sources(docs: DataFrame, weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS, seed: int = 17, size: Column | None = None, weight: Column | None = None) -> DataFrame:
    """How often the mix takes each document.

    Returns a row for each (doc_id, source, size) found: doc_id, source, size, rows (how many
    input rows agree in these), source_size, target, epochs, extra. Every row is taken
    ``epochs`` times, and ``extra`` of the rows once more. Whole documents are taken: the last
    one of a source goes in if that brings the source nearer its target, so a source misses it
    by half a document at most, repeated rows or not.

    Null text counts as no words; null doc_id and null source are values like others; an
    empty table gives no rows; other columns of ``docs`` are ignored.
    """
    size = words_in(F.col("text")) if size is None else size
    weight = quality(F.coalesce(F.col("text"), F.lit(""))) if weight is None else weight
    base = docs.select("doc_id", "source", size.cast("long").alias("size"), weight.cast("double").alias("weight"))
    base = base.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"), F.max("weight").alias("weight"))
    base = staged(base, "mix")
    per = base.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("__n"), F.avg("weight").alias("__mean"))
    targets = staged(source_targets(per, weights, share, max_epochs).withColumn("__buckets", buckets_for(F.col("__n"))).withColumnRenamed("source", "__source"), "mix-targets")
    rows = base.join(targets, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    # u ** (w / mean w): by its size rows are dealt to buckets, so that a bucket's keys are all below the next one's
    rows = rows.withColumn("__key", -F.log(unit_hash(seed, F.col("doc_id"), F.col("size"))) * F.col("__mean") / F.col("weight"))
    rows = rows.withColumn("__bucket", F.least(F.col("__buckets") - 1, F.floor((1 - F.exp(-F.col("__key"))) * F.col("__buckets"))).cast("int"))
    rows = rows.withColumn("__amount", F.col("size") * F.col("rows"))
    rows = running_total(rows, ["source_no"], "__bucket", ["__key", "doc_id", "size"], "__amount", "__before")
    # of rows that agree, as many as come nearest to what is left of the budget
    fit = F.floor((F.col("budget") - F.col("__before")) / F.greatest(F.col("size"), F.lit(1)) + F.lit(0.5))
    extra = F.when((F.col("budget") > 0) & (F.col("size") > 0), F.greatest(F.lit(0), F.least(F.col("rows"), fit))).otherwise(0)
    return rows.select("doc_id", "source", "size", "rows", "source_size", "target", "epochs", extra.cast("long").alias("extra"))


def taken_rows(mix: DataFrame) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, copies, taken."""
    each = one_by_one(mix, "rows", "__row")
    copies = F.col("epochs") + F.when(F.col("__row") <= F.col("extra"), 1).otherwise(0)
    return each.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``mix_sources`` takes it, columns kept, whatever their names.

    Of rows that agree in doc_id, source and size, and of which only some are taken once more
    (one such group a source at most), those with the smallest hashes are. Documents without
    words are taken as often as whole epochs are. An empty table gives no rows.
    """
    mix = mix_sources(docs, **options).filter("epochs > 0 OR extra > 0").select("doc_id", "source", "size", "rows", "epochs", "extra")
    size = options.get("size")
    found = docs.select(F.col("doc_id").alias("i"), F.col("source").alias("s"), (words_in(F.col("text")) if size is None else size).cast("long").alias("n"), whole(docs).alias("row"))
    on = F.col("i").eqNullSafe(F.col("doc_id")) & F.col("s").eqNullSafe(F.col("source")) & (F.col("n") == F.col("size"))
    split = F.col("extra").between(F.lit(1), F.col("rows") - 1)
    alike = found.join(mix.filter(~split), on).select("row", (F.col("epochs") + F.when(F.col("extra") > 0, 1).otherwise(0)).alias("copies"))
    # the groups that the budget cuts: numbered in buckets, by what is written once
    partly = found.join(staged(mix.filter(split), "mix-split"), on).select("i", "s", "n", "rows", "epochs", "extra", "row", F.monotonically_increasing_id().alias("at"))
    partly = staged(partly, "mix-split-rows").withColumn("bucket", F.pmod(F.xxhash64("at"), buckets_for(F.col("rows")).cast("long")).cast("int"))
    group = F.struct("i", "s", "n")
    partly = running_total(partly.withColumn("group", group), ["group"], "bucket", ["at"], None, "before")
    partly = partly.select("row", (F.col("epochs") + F.when(F.col("before") < F.col("extra"), 1).otherwise(0)).alias("copies"))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")))
    return alike.unionByName(partly).filter("copies > 0").select("row", copies).select("row.*")
