"""Connected components of a graph of links, as DataFrame operations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", rounds: int = 200) -> DataFrame:
    """(node, root) for each node that has a link: root is the smallest node it reaches.

    Alternates large-star and small-star: every node links its larger, then its
    smaller neighbours to the smallest of them, until no edge changes.  A hub's
    neighbours meet only in aggregates that are combined before the shuffle, and in a
    join whose skewed partitions Spark splits.  Each round is written to the shared
    folder, so a lost executor costs one round at most.  Rounds grow with the logarithm
    of the longest path; should ``rounds`` not do, that is an error.
    """
    e = scratch.save(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    seen = scratch.digest(e)
    for _ in range(rounds if seen[0] else 0):
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("x", "m"))
        large = scratch.save(both.filter("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.save(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(e)
        scratch.drop(large)
        e, last, seen = new, seen, scratch.digest(new)
        if seen == last:
            break
    else:
        if seen[0]:
            raise RuntimeError(f"components are not found after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


class Forest:
    """Union-find over 0..n-1 in one task; the smallest item of a tree is its root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y

    def roots(self) -> np.ndarray:
        """The root of every item."""
        up = np.array(self.up, np.int64)
        while (up[up] != up).any():
            up = up[up]
        self.up = up.tolist()
        return up

    def links(self) -> np.ndarray:
        """(item, root) of all items that are not roots."""
        up = self.roots()
        at = np.flatnonzero(up != np.arange(len(up)))
        return np.stack([at, up[at]], 1)
