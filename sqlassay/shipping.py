"""Make this package importable in Python workers that were not started with it on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once per application, through Spark's own file server."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="sqlassay-")) / "sqlassay_package.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, str(p.relative_to(here.parent)))
        spark.sparkContext.addPyFile(str(path))
        _shipped.add(app)
    return spark
