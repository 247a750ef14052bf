"""What the corpus operators share: scratch tables, word counts, distributed prefix sums."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder under spark.checkpoint.dir, deleted when the driver's JVM ends.

    Where that setting is missing, a local session (tests, a laptop) uses a temporary folder;
    a cluster, whose executors could not read it, is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.gettempdir() + "/sqlassay-scratch"
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hpath)
    fs.deleteOnExit(hpath)
    whole = fs.makeQualified(hpath).toString()  # with its scheme, for readers that are not Hadoop's
    return "file://" + whole[5:] if whole.startswith("file:/") and not whole.startswith("file://") else whole


def staged(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back.

    This cuts lineage in a way that survives lost executors, and later plans see real sizes.
    """
    spark = df.sparkSession
    path = scratch(spark, tag) + "/t"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path  # type: ignore[attr-defined]
    return out


def discard(*staged_tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again, and let Spark drop the shuffle files of finished jobs."""
    for df in staged_tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        forget_shuffles(df.sparkSession)


def forget_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of finished jobs, whose plans nothing holds any more, now and not in half an hour."""
    for _ in range(2):  # the first collection only finds what the last job's plan held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def whole(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct: whatever their names, they clash with no working column."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def row_key() -> Column:
    """What tells rows apart by doc_id and text: bytes that are equal only if both are; null text counts as empty."""
    name = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
    return F.concat(F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)), F.encode(name, "UTF-8"))


def rows_with_keys(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Of each ``key`` (row_key) in ``keys`` one row of ``docs``, with its columns; texts are shuffled once."""
    rows = docs.select(row_key().alias("key"), whole(docs).alias("row")).groupBy("key").agg(F.first("row").alias("row"))
    return rows.join(keys.select("key"), "key", "left_semi").select("row.*")


def one_by_one(groups: DataFrame, count: str, out: str, most: int = 4096) -> DataFrame:
    """A row for each of the ``count`` members of a group, numbered from 1; large groups are dealt over tasks in blocks."""
    n = F.col(count).cast("long")
    small = groups.filter(n.between(1, most)).withColumn(out, F.explode(F.sequence(F.lit(1).cast("long"), n)))
    large = groups.filter(n > most).withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / most))))
    large = large.repartition(*[c for c, t in large.dtypes if not t.startswith("map")])
    first = F.col("__block") * most
    large = large.withColumn(out, F.explode(F.sequence(first + 1, F.least(n, first + most))))
    return small.unionByName(large.drop("__block"))


def words_in(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, WORD, "w"), r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def unit_hash(seed: int, *cols: Column) -> Column:
    """A number in (0, 1) that the columns and the seed decide."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**53))


def running_total(df: DataFrame, groups: list[str], bucket: str, order: list, value: str | None, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` (or the number of rows) before a row, in its group.

    Rows are ordered by ``bucket`` and, within it, by ``order``. No task sees more than one
    bucket of rows: totals by bucket are summed first, so a group that holds a third of all
    rows is spread over its buckets. ``groups`` and ``bucket`` must not hold nulls.
    """
    amount = F.col(value) if value else F.lit(1).cast("long")
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*groups, bucket).agg(F.sum(amount).alias("__sum"))
    totals = totals.select(*groups, bucket, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__rt_before"))
    inside = Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__rt_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return rows.join(totals, [*groups, bucket]).withColumn(out, F.col("__rt_inside") + F.col("__rt_before")).drop("__rt_inside", "__rt_before")


def buckets_for(rows: Column, rows_each: int = 512, most: int = 65536) -> Column:
    """How many buckets a group of so many rows is dealt into."""
    return F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(rows / F.lit(rows_each)))).cast("int")


def join_hot(rows: DataFrame, table: DataFrame, on: str, least: int = 4096) -> DataFrame:
    """``rows`` joined with their row of ``table`` (one for each value of ``on``), however many rows share a value.

    Values with more than a 20 000th of all rows, and more than ``least``, are looked up in a
    broadcast part of ``table`` (fewer than 20 000 rows of it); only the others are shuffled.
    ``rows`` is read three times: it should be on disk.
    """
    least = max(least, rows.count() // 20_000)
    hot = rows.groupBy(on).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > least).select(on)
    hot = staged(hot, "hot-keys")
    if hot.isEmpty():
        return rows.join(table, on)
    few = staged(table.join(F.broadcast(hot), on, "left_semi"), "hot-rows")
    return rows.join(F.broadcast(hot), on, "left_anti").join(table, on).unionByName(rows.join(F.broadcast(few), on))


def maybe_in(ids: DataFrame, column: str, most_bits: int = 1 << 28):
    """A predicate over a long column: true for all that are in ``ids``, and for few others.

    A Bloom filter of 16 bits an id, of ``most_bits`` at most (32 MB), is put together from
    segments and broadcast; beyond its size it is true more often.
    """
    spark = ship(ids.sparkSession)
    n = ids.count()
    power = min(max(n * 16, 1 << 16), most_bits).bit_length() - 1
    segment = 1 << min(power, 20)

    def places(x: np.ndarray) -> np.ndarray:
        a = x.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        b = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.stack([(a >> np.uint64(64 - power)), (b >> np.uint64(64 - power))]).astype(np.int64)

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits: dict[int, np.ndarray] = {}
        for f in frames:
            at = places(f[column].to_numpy()).ravel()
            for s in np.unique(at // segment).tolist():
                bits.setdefault(s, np.zeros(segment, bool))[at[at // segment == s] % segment] = True
        yield pd.DataFrame([(s, np.packbits(b).tobytes()) for s, b in bits.items()], columns=["s", "bits"])

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        both = np.bitwise_or.reduce(np.stack([np.frombuffer(x, np.uint8) for x in f["bits"]]))
        return pd.DataFrame({"s": f["s"][:1], "bits": [both.tobytes()]})

    whole = np.zeros((1 << power) // 8, np.uint8)
    shape = "s long, bits binary"
    for r in ids.select(column).mapInPandas(mark, shape).groupBy("s").applyInPandas(merge, shape).toLocalIterator():
        whole[r["s"] * segment // 8 : (r["s"] + 1) * segment // 8] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(whole)

    @F.pandas_udf("boolean")
    def may(x: pd.Series) -> pd.Series:
        at = places(x.to_numpy())
        return pd.Series(((shared.value[at >> 3] >> (7 - (at & 7))) & 1).all(0))

    return may


def only_ids(rows: DataFrame, column: str, ids: DataFrame, most_bits: int = 1 << 28) -> DataFrame:
    """``rows`` without most of those whose ``column`` (long) is not in ``ids``, before they are shuffled."""
    return rows.filter(maybe_in(ids, column, most_bits)(F.col(column)))

