"""Connected components by alternating stars, every round cut to a shared table.

Each round points neighbours at the smallest node of their neighbourhood, first
the larger neighbours (large star), then the smaller ones (small star); when a
round changes nothing every node points at the smallest node it can reach.  The
rounds needed grow with the logarithm of a component's width.  Minima are combined
before the shuffle, and joins run between written tables, so adaptive execution
may split a node with very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritome.llm import scratch


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")).alias("h")).first()
    return row.n, int(row.h or 0)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with a link; the component is its smallest node."""
    edges = scratch.cut(links.where(links[a] != links[b]).select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).distinct())
    state = _state(edges)
    while True:
        both = edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = scratch.cut(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m")))
        large = scratch.cut(both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct())
        low = scratch.cut(large.groupBy("x").agg(F.min("y").alias("m")))
        small = large.join(low, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(low.select("x", F.col("m").alias("y")))
        after = scratch.cut(small.distinct())
        scratch.drop(least, large, low)
        now = _state(after)
        scratch.drop(edges)
        edges = after
        if now == state:
            return edges.select(F.col("x").alias("node"), F.col("y").alias("component")).unionByName(edges.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct())
        state = now
