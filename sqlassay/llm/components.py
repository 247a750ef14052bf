"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import join_hot, staged


#: Links that one task puts together.
TASK_LINKS = 500_000


def _forest(links: DataFrame) -> DataFrame:
    """(id, component) of at most TASK_LINKS links, by union-find in one task."""

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [f[["a", "b"]].to_numpy(np.int64) for f in frames]
        pairs = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
        names, number = np.unique(pairs, return_inverse=True)  # sorted, so the least number is the least id
        up = list(range(len(names)))

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for x, y in number.reshape(-1, 2).tolist():
            x, y = root(x), root(y)
            up[max(x, y)] = min(x, y)
        yield pd.DataFrame({"id": names, "component": names[[root(x) for x in range(len(names))]] if len(names) else names})

    ship(links.sparkSession)
    return staged(links.select("a", "b").repartition(1).mapInPandas(join, "id long, component long"), "components")


def components(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """(a, b) -> (id, component): each linked id and the smallest id it reaches.

    As long as there are more links than a task can hold, each id points, in a round, to its
    smallest neighbour or itself, pointers are followed twice, and the links are drawn anew
    between the ids pointed to; those that vanish are done. In every connected part at least
    half of the ids vanish, so the rounds end. What is left then is put together in one task.
    Every round is written to the shared folder; an id that very many point to is looked up,
    not shuffled to. No links give no rows.
    """
    edges = staged(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")
    maps: list[DataFrame] = []
    while edges.count() > task_links:
        both = edges.union(edges.select("b", "a"))
        to = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("to")).select("id", F.least("id", "to").alias("to"))
        to = staged(to, "pointers")
        for _ in range(2):
            nxt = to.select(F.col("id").alias("to"), F.col("to").alias("__next"))
            to = staged(join_hot(to, nxt, "to").select("id", F.col("__next").alias("to")), "pointers")
        maps.append(to.select("id", F.col("to").alias("component")))
        left = join_hot(edges, to.withColumnRenamed("id", "a"), "a").select("b", F.col("to").alias("x"))
        left = join_hot(staged(left, "half-links"), to.withColumnRenamed("id", "b"), "b").select("x", F.col("to").alias("y")).filter("x <> y")
        edges = staged(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    maps.append(_forest(edges))

    def follow(done: DataFrame, later: DataFrame) -> DataFrame:
        # an id that a later round moves is one of those that ids of this one point to; the others stay
        step = later.select(F.col("id").alias("component"), F.col("component").alias("__to"))
        return staged(done.join(step, "component", "left").select("id", F.coalesce("__to", "component").alias("component")), "components")

    return reduce(follow, maps[1:], maps[0])
