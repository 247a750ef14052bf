"""Sharding by Hilbert-curve order (DataFrame functions only).

Several metadata dimensions are quantised, equally full, to a few bits each; rows are sorted
by their cell's place on the Hilbert curve through that grid and cut into runs. Each run
spans a compact part of every dimension, so that files can be skipped by any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, running_total, staged, whole

BITS = 4
#: Ranges that a dimension's values are dealt into, to add up their counts in order.
RANGES = 1024


def hilbert_index(cell: Column, dims: int, bits: int = BITS) -> Column:
    """Place on the curve of an array of ``dims`` integers of ``bits`` bits (Skilling's transform)."""
    steps = [(1 << b, i) for b in range(bits - 1, 0, -1) for i in range(dims)]
    x = cell
    if steps:
        table = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q, i in steps])

        def turn(acc, s):
            first, own, low = F.element_at(acc, 1), F.element_at(acc, s["i"] + 1), s["q"] - 1
            swap = (first.bitwiseXOR(own)).bitwiseAND(low)
            invert = F.transform(acc, lambda v, j: F.when(j == 0, v.bitwiseXOR(low)).otherwise(v))
            exchange = F.transform(acc, lambda v, j: F.when((j == 0) | (j == s["i"]), v.bitwiseXOR(F.when(s["i"] == 0, F.lit(0)).otherwise(swap))).otherwise(v))
            return F.when(own.bitwiseAND(s["q"]) != 0, invert).otherwise(exchange)

        x = F.aggregate(table, x, turn)
    gray = F.aggregate(
        F.slice(x, 2, dims),
        F.slice(x, 1, 1),
        lambda acc, v: F.concat(acc, F.array(v.bitwiseXOR(F.element_at(acc, -1)))),
    )
    levels = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<int>")
    flip = F.aggregate(levels, F.lit(0), lambda t, q: F.when(F.element_at(gray, -1).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
    order = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(dims)])
    done = F.transform(gray, lambda v: v.bitwiseXOR(flip))
    return F.aggregate(
        order,
        F.lit(0).cast("long"),
        lambda h, s: h * 2 + F.when(F.element_at(done, s["i"] + 1).bitwiseAND(F.element_at(F.array(*[F.lit(1 << b) for b in range(bits)]), s["b"] + 1)) != 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")),
    )


def _cuts(rows: DataFrame, name: str, bits: int) -> tuple[Column, list]:
    """The column to compare, and at most 2 ** bits - 1 values that part it into equally full cells.

    Whatever the number of distinct values: whole values are counted, dealt into ranges in
    their order, and the counts before each are added up by range.
    """
    column = F.coalesce(F.col(name), F.lit("" if dict(rows.dtypes)[name] == "string" else 0))
    counts = staged(rows.groupBy(column.alias("v")).agg(F.count(F.lit(1)).alias("n")), "values")
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return column, []
    # which range a value is in decides where it is added up, not the sum before it
    ranges = staged(counts.repartitionByRange(RANGES, "v").withColumn("range", F.spark_partition_id()), "ranges")
    before = running_total(ranges, [], "range", ["v"], "n", "before")
    cells = before.select("v", F.floor(F.col("before") / F.lit(total) * (1 << bits)).alias("cell")).groupBy("cell").agg(F.min("v").alias("v"))
    return column, sorted((r["v"] for r in cells.collect()), key=lambda v: v.encode() if isinstance(v, str) else v)[1:]


def _described(docs: DataFrame) -> list[Column]:
    text = F.col("text")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    return [F.col("doc_id"), size.alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.col("lang"), F.col("source")]


def _assigned(rows: DataFrame, shards: int, bits: int) -> DataFrame:
    """Add shard, slot, hilbert to staged rows (size, lang, source, row: a number of its own)."""
    rows = rows.withColumn("__log", F.floor(F.log2("size") * 4).cast("int"))
    cell = []
    for name in ("__log", "source", "lang"):
        column, cuts = _cuts(rows, name, bits)
        cell.append(sum((F.when(column >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)))
    rows = rows.withColumn("__cell", F.array(*cell))
    # at most 2 ** (3 * bits) rows from here to the join
    cells = rows.groupBy("__cell").agg(F.count(F.lit(1)).alias("__n"))
    cells = cells.withColumn("hilbert", hilbert_index(F.col("__cell"), 3, bits))
    before = Window.orderBy("hilbert").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumn("__total", F.sum("__n").over(Window.partitionBy()))
    cells = staged(cells.withColumn("__buckets", buckets_for(F.col("__n"))), "hilbert-cells")
    rows = rows.join(F.broadcast(cells), "__cell")
    # dealt by the row's own number: rows that are equal in everything do not share a bucket
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64("row"), F.col("__buckets").cast("long")).cast("int"))
    rows = running_total(rows, ["hilbert"], "__bucket", ["row"], None, "__rank")
    rank = F.col("__rank") + F.col("__first")
    rows = rows.withColumn("__rank", rank).withColumn("shard", F.floor(F.col("__rank") * shards / F.col("__total")).cast("int"))
    start = F.ceil(F.col("shard").cast("long") * F.col("__total") / shards)
    return rows.withColumn("slot", (F.col("__rank") - start).cast("long"))


def _result(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "lang", "source", "hilbert")


def hilbert_shards(docs: DataFrame, shards: int = 8, bits: int = BITS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null), lang, source, hilbert.

    Dimensions: size (by its logarithm), source, lang. ``size`` is the text's UTF-8 bytes plus
    one. Shards are runs of the curve whose row counts differ by one at most; slots count from
    0 within a shard. Within a cell the order is that of the input's files. Nulls sort as empty
    values, a null text has size 1; repeated rows get slots of their own; an empty table gives
    no rows; other columns are ignored.
    """
    rows = docs.select(*_described(docs), F.monotonically_increasing_id().alias("row"))
    return _result(_assigned(staged(rows, "hilbert"), shards, bits))


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> DataFrame:
    """Write ``docs`` as one folder per shard, rows in curve order; returns the assignment, as hilbert_shards() does.

    Every row, repeated ones too, is written under a slot of its own. The added columns are
    called shard and slot, with underscores after them where ``docs`` has such names. An empty
    table writes no rows.
    """
    taken = {c.lower() for c in docs.columns}
    names = []
    for name in ("shard", "slot"):
        while name in taken:
            name += "_"
        names.append(name)
    base = staged(docs.select(whole(docs).alias("doc"), F.monotonically_increasing_id().alias("row")), "hilbert-rows")
    rows = base.select("row", *[F.col(f"doc.{c}") for c in ("doc_id", "text", "lang", "source")])
    plan = staged(_assigned(staged(rows.select("row", *_described(rows)), "hilbert"), shards, BITS), "hilbert-plan")
    placed = base.join(plan.select("row", F.col("shard").alias("__shard"), F.col("slot").alias("__slot")), "row")
    out = placed.repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot")
    out.select("doc.*", F.col("__shard").alias(names[0]), F.col("__slot").alias(names[1])).write.partitionBy(names[0]).parquet(path)
    return _result(plan)
