"""Connected components by alternating star contractions (Kiveris et al., 2014), as joins and aggregates.

Each round is written to the shared folder. A vertex with very many edges is one key of a join against a table with
one row per vertex, which adaptive execution can split; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regfeed.llm.common import stored


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component`` for every vertex of ``edges`` (two BIGINT columns) that is not its component's smallest.

    Vertices that are missing, or have edges to themselves only, are components of their own. Edges with NULL are left out.
    """
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    pairs = pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    pairs = stored(pairs, "edges")
    before = _signature(pairs)
    while before[0]:
        # Large star: whatever is above a vertex is tied to the smallest vertex around it.
        around = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = pairs.join(least, "v").select("u", F.col("m").alias("v")).distinct()
        # Small star: a vertex and all below it are tied to the smallest of them.
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        pairs = stored(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _signature(pairs)
        if now == before:
            break
        before = now
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component"))


class Forest:
    """Union-find over 0..n-1 inside one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def union(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
