"""Connected components of an edge table by repeated large-star and small-star steps (Kiveris et al., 2014).

Each step is one grouped aggregation and one join on node ids; the number of steps grows with the logarithm of the
longest path, and what each step leaves is written to the shared folder. Both sides of each join are tables,
so Spark splits the rows of a node with many neighbours over tasks. Nothing about edges or components is collected, only a sum that tells whether a step changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stash


def components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """edges: columns a and b of one orderable type. Returns (node, root): every node of an edge with the smallest node it reaches."""
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    now, seen = stash(edges.select("a", "b").filter("a <> b").distinct(), "edges"), None
    for _ in range(max_steps):
        links = both(now)
        least = stash(links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        # Large star: every larger neighbour of u is tied to the least node about u.
        large = stash(links.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "large")
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        lowest = stash(down.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        # Small star: every smaller neighbour of u, and u, are tied to the least of them.
        small = down.join(lowest, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(lowest.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()
        now = stash(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_steps} steps")
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
