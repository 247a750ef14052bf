"""Tables in the folder that driver and executors share, which cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, tag: str) -> str:
    """A new folder under spark.checkpoint.dir, deleted when the driver's JVM ends.

    Without that setting a local session uses a temporary folder; a cluster is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.gettempdir() + "/sqlassay-staging"
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(hadoop)
    files.deleteOnExit(hadoop)
    return path


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df``, written there and read back."""
    path = folder(df.sparkSession, tag) + "/t"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
