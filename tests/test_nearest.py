"""Nearest vectors by blocks, against every pair."""

import numpy as np
from pyspark.sql import functions as F

from sqlassay.operators import retrieval


def test_nearest_by_blocks_keeps_ties_and_short_lists(spark):
    # copies make ties, which go by id; blocks of a few rows and queries change nothing, nor do fewer rows than k
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 5))
    rows = [(k, [float(x) for x in base[k % 12]], k % 3) for k in range(60)]
    e = retrieval.with_unit_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    q = e.filter("vec_id % 7 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"), F.col("label").alias("q_label"))
    items = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    for some, k in ((items, 6), (items.filter("id < 4"), 6)):
        every = retrieval.scored(q, some, F.col("q_id") != F.col("id")).withColumn("similarity", F.round("similarity", 9))
        order = (F.desc("similarity"), F.col("id"))
        want = sorted((r["q_id"], r["rank"], r["id"], r["q_label"], r["label"]) for r in retrieval.top(every, k, *order).collect())
        for blocks in ((7, 3), (1000, 1000)):
            cut = retrieval.nearest(q, some, k, *blocks)
            assert sorted((r["q_id"], r["rank"], r["id"], r["q_label"], r["label"]) for r in retrieval.top(cut, k, *order).collect()) == want


def test_queries_rank_no_more_than_blocks_keep(spark, small):
    # what is ranked after the comparison is k rows for each query and block, not every pair
    from sqlassay.plans import tables

    asked = spark.read.parquet(f"{small}/embeddings.parquet").filter("vec_id % 50 = 0").count()
    assert tables._pairs(spark, small, 3).count() == 3 * asked


def test_nearest_of_nothing(spark):
    none = spark.createDataFrame([], "id long, vec array<double>, label int")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "q_id long, q_vec array<double>")
    assert retrieval.nearest(asked, none, 3).count() == 0


def test_products_of_a_cell_are_bounded():
    # as many queries as may probe one cell: pieces of bounded size, nobody left out
    from sqlassay.operators import vector_index

    who = np.arange(24_000)
    pieces = vector_index._few(who, 10_000)
    assert max(map(len, pieces)) * 10_000 <= retrieval.PRODUCTS and np.array_equal(np.concatenate(pieces), who)
    near = np.array([[1.0, 3.0, 3.0, 2.0, 3.0], [0.0, 0.0, 0.0, 0.0, 5.0]])
    row, column = retrieval.best_of_rows(near, 2)
    assert list(zip(row.tolist(), column.tolist())) == [(0, 1), (0, 2), (1, 4), (1, 0)]
