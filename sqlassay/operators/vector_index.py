"""A partitioned inverted file for vector search: cells as Parquet partitions, probes for each query, exact scores in them.

Vectors are dealt to the nearest of some centres, fitted on a bounded sample; every row is
indexed. A search reads only the partitions of the cells that its queries probe, scores what is
in them exactly, and gives the best. With as many probes as cells it is the exact search.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import retrieval

#: Vectors that centres are fitted on at most; cells at most; rows in one file of a cell.
SAMPLE, MOST_CELLS, FILE_ROWS = 50_000, 4096, 200_000
#: Rows whose neighbours tell how many probes are needed.
TRIALS = 256
#: Queries that are sent to all tasks at once.
BLOCK = 20_000


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Rows of length 1; a zero vector stays."""
    m = np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, 1))
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size > 0, size, 1)


def centres(items: DataFrame, cells: int | None = None, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Centres of (id, vec): as many as the square root of the rows, or ``cells``; fitted on ``sample`` rows at most, chosen by a hash of their id."""
    n = items.count()
    if not n:
        return np.zeros((0, 1))
    cells = min(cells or max(1, round(n**0.5)), MOST_CELLS, max(n, 1))
    share = min(1.0, 1.1 * sample / max(n, 1))
    some = items.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(sample) if share < 1 else items
    if cells == 1:
        return np.zeros((1, len(items.first()["vec"])))
    points = some.select(array_to_vector(retrieval.normalised(F.col("vec"))).alias("features"))
    found = KMeans(k=cells, seed=seed, maxIter=15).fit(points).clusterCenters()
    found = np.array(found)
    size = np.linalg.norm(found, axis=1, keepdims=True)
    return found / np.where(size > 0, size, 1)


def nearest_centres(vectors: np.ndarray, where: np.ndarray, many: int) -> np.ndarray:
    """The numbers of the nearest centres of each vector, nearest first."""
    return np.argsort(-(vectors @ where.T), axis=1, kind="stable")[:, :many].astype(np.int32)


def build(items: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE) -> None:
    """Write the index of items (id, vec, ...) under ``path``: a partition for each cell, and the centres.

    A cell that holds very many rows is written by several tasks, in several files.
    """
    spark = items.sparkSession
    where = centres(items, cells, sample)
    shared = ship(spark).sparkContext.broadcast(where)

    @F.pandas_udf("int")
    def cell(vectors: pd.Series) -> pd.Series:
        return pd.Series(nearest_centres(_matrix(vectors), shared.value, 1)[:, 0])

    dealt = items.withColumn("cell", cell("vec"))
    sizes = dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).cast("int").alias("files"))  # a row a cell
    dealt = dealt.join(F.broadcast(sizes), "cell").withColumn("file", F.pmod(F.xxhash64("id"), F.col("files")))
    dealt.repartition("cell", "file").drop("file", "files").write.partitionBy("cell").mode("overwrite").parquet(f"{path}/cells")
    about = spark.createDataFrame([(json.dumps(where.tolist()),)], "centres string").coalesce(1)
    about.write.mode("overwrite").parquet(f"{path}/centres")
    curve = recall_curve(items.select(F.col("id").alias("q_id"), "vec"), path) if len(where) > 1 else [1.0]
    about.withColumn("recall", F.lit(json.dumps(curve))).write.mode("overwrite").parquet(f"{path}/recall")


def recall_curve(queries: DataFrame, path: str, k: int = 10) -> list[float]:
    """The share of the k nearest rows that lie in the first 1, 2, ... cells, over TRIALS of the queries, chosen by a hash of their id."""
    some = queries.orderBy(F.xxhash64("q_id"), "q_id").limit(TRIALS)
    where = _centres(queries.sparkSession, path)
    cells = search(some, path, k, len(where), keep_cell=True).select("q_id", "cell").toPandas()  # k rows a trial
    asked = some.toPandas()
    order = dict(zip(asked["q_id"], nearest_centres(_matrix(asked["vec"]), where, len(where)).argsort(1)))
    turn = np.array([order[q][c] for q, c in zip(cells["q_id"], cells["cell"])], np.int64)
    return (np.cumsum(np.bincount(turn, minlength=len(where))) / max(len(turn), 1)).tolist()


def probes_for(spark: SparkSession, path: str, least: float) -> int:
    """The number of probes that gave ``least`` recall or more when the index was built."""
    curve = json.loads(spark.read.parquet(f"{path}/recall").first()["recall"])
    return int(np.searchsorted(np.array(curve), least - 1e-12)) + 1


def _centres(spark: SparkSession, path: str) -> np.ndarray:
    return np.array(json.loads(spark.read.parquet(f"{path}/centres").first()["centres"]))


def search(queries: DataFrame, path: str, k: int, probes: int | None = None, least: float = 0.95, keep_cell: bool = False) -> DataFrame:
    """(q_id, id, ..., rank, similarity): the best k of each of queries (q_id, vec), from the ``probes`` cells nearest to it.

    Without ``probes``, as many as gave a recall of ``least`` on a sample of the rows.

    Queries are sent to the tasks, a block of BLOCK at a time. The cells that they probe are
    named to the reader, so only their files are read, and no row of the index is shuffled: a
    task scores its rows with the queries that probe their cell and keeps the best k of each.
    """
    spark = queries.sparkSession
    where = _centres(spark, path)
    probes = probes or probes_for(spark, path, least)
    rows = spark.read.parquet(f"{path}/cells")
    blocks = max(1, -(-queries.count() // BLOCK))
    found = None
    for b in range(blocks):
        asked = queries.select("q_id", "vec").filter(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == b).toPandas()  # BLOCK rows or so
        vectors = _matrix(asked["vec"])
        near = nearest_centres(vectors, where, max(1, min(probes, len(where)))) if len(asked) else np.zeros((0, 1), np.int32)
        best = _best_in_cells(rows.filter(F.col("cell").isin(np.unique(near).tolist())), asked["q_id"].to_numpy(), vectors, near, k, dict(queries.dtypes)["q_id"], keep_cell)
        found = best if found is None else found.unionByName(best)
    kept = [c for c in found.columns if c not in ("q_id", "similarity")]
    return retrieval.top(found, k, F.desc("similarity"), F.col("id")).select("q_id", *kept, "rank", "similarity")


def _few(who: np.ndarray, rows: int) -> list[np.ndarray]:
    """``who`` in pieces, each with no more products with ``rows`` vectors than a task may hold."""
    step = max(1, retrieval.PRODUCTS // max(rows, 1))
    return [who[a : a + step] for a in range(0, len(who), step)]


def _best_in_cells(rows: DataFrame, q_ids: np.ndarray, vectors: np.ndarray, near: np.ndarray, k: int, q_type: str, keep_cell: bool) -> DataFrame:
    """Of each batch of rows (cell, id, vec, ...) the best k for each query that probes their cell; similarities to twelve places, ties by id."""
    kept, types = [c for c in rows.columns if c != "vec" and (keep_cell or c != "cell")], dict(rows.dtypes)
    shape = f"q_id {q_type}, similarity double, " + ", ".join(f"`{c}` {types[c]}" for c in kept)
    probing = {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}
    shared = ship(rows.sparkSession).sparkContext.broadcast((q_ids, vectors, probing))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, asked, cells = shared.value
        for f in frames:
            for c, some in f.sort_values("id", kind="stable").groupby("cell", sort=False):
                who = cells[int(c)]
                some_vectors, own = _matrix(some["vec"]).T, some[kept]
                # some queries at a time: what a task holds does not grow with those that probe a cell
                for few in _few(who, len(some)):
                    near = (asked[few] @ some_vectors).round(12)
                    row, column = retrieval.best_of_rows(near, k)
                    out = own.iloc[column].reset_index(drop=True)
                    out.insert(0, "q_id", names[few][row])
                    out.insert(1, "similarity", near[row, column])
                    yield out

    return rows.mapInPandas(score, shape)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: of the exact pairs (q_id, id), how many there are and how many were found."""
    hit = found.select("q_id", "id", F.lit(1).alias("hit"))
    return exact.select("q_id", "id").join(hit, ["q_id", "id"], "left").agg(F.count(F.lit(1)).alias("pairs"), F.count("hit").alias("found"))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of what is left of found pairs, ranked anew."""
    return retrieval.top(found.drop("rank"), k, F.desc("similarity"), F.col("id"))


def files(spark: SparkSession, path: str) -> int:
    return len(spark.read.parquet(f"{path}/cells").inputFiles())


def files_read(queries: DataFrame, path: str, probes: int | None = None, least: float = 0.95) -> list[str]:
    """The files that a search with these queries opens."""
    spark = queries.sparkSession
    where = _centres(spark, path)
    asked = queries.toPandas()  # the queries of one search
    near = nearest_centres(_matrix(asked["vec"]), where, min(probes or probes_for(spark, path, least), len(where)))
    rows = spark.read.parquet(f"{path}/cells").filter(F.col("cell").isin(np.unique(near).tolist()))
    return [r["f"] for r in rows.select(F.input_file_name().alias("f")).distinct().collect()]  # a row a file
