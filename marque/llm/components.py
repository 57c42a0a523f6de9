"""Distributed union-find: connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marque.llm.shared import cut, drop


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One contraction. Minima are aggregated before the shuffle; a hub's edges, 16 bytes each, stream past its minimum in one task of the join."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    j = both.join(least, "a")
    if small:  # b < a: every smaller neighbour, and a itself, go to the smallest
        out = j.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    else:  # every larger neighbour goes to the smallest
        out = j.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of any orderable type -> (node, root): the least node of its component, for every node of an edge.

    Self-loops and repeated edges change nothing; nulls must be absent. Each contraction is
    written to the shared folder. It ends when a pass changes nothing; every pass lowers some node's parent.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        mark = seen
        new = cut(_star(_star(now, False), True))
        drop(now)
        now = new
