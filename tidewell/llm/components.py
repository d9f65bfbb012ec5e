"""Connected components of an edge table, by alternating large and small stars.

Every round links the larger neighbours of a node to its smallest one, then the smaller
ones; the number of rounds grows with the logarithm of the longest path.  Edges stay in
tables; each round is written to the shared folder, and only a count and a sum come back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.sources.store import drop, scratch, stored


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """`node` and `root` (the smallest node of its component) of every node in edges (a, b)."""
    spark = edges.sparkSession
    folder = scratch(spark, "components")
    e = edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x <> y").distinct()
    e, before, old = stored(e, f"{folder}/0"), None, f"{folder}/0"

    def least(at: str) -> DataFrame:
        """The smallest neighbour of the nodes that have a smaller one.  Written, so that the join
        that follows can be split where a node has very many neighbours."""
        return stored(e.groupBy("x").agg(F.min("y").alias("m")), at)

    for turn in range(1, max_rounds + 1):
        at = f"{folder}/{turn}"
        # a node's larger neighbours go to its smallest one; a node without smaller ones keeps them
        m = least(f"{at}-a").select(F.col("x").alias("y"), "m")
        e = stored(e.join(m, "y", "left").select("x", F.coalesce("m", "y").alias("y")).distinct(), f"{at}-b")
        # so do its smaller neighbours and the node itself
        m = least(f"{at}-c")
        small = e.join(m, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        e = stored(small.union(m.select("x", F.col("m").alias("y"))).distinct(), at)
        for used in (old, f"{at}-a", f"{at}-b", f"{at}-c"):
            drop(spark, used)
        old = at
        row = e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("x", "y"), F.lit(1 << 40)))).first()
        if tuple(row) == before:
            break
        before = tuple(row)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("x").alias("node"), F.col("y").alias("root")).union(e.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())


class Forest:
    """Union-find over 0..n - 1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b
