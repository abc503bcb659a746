"""Connected components of a link table, by contraction.

In each round every node moves to the neighbour of the lowest hash, if that is below its own, and
the links between what the nodes moved to are the next round's. Hashes make long ordered chains
shrink by a constant factor. All state is in stored tables; the driver sees counts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import dropped, stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b); a root stands for its component and maps to itself."""
    edges = stored(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("x"))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        moved = stored(best.select(F.col("a").alias("node"), F.least(F.col("m"), rank("a"))["x"].alias("to")), "moved")
        first = roots is None
        if first:
            roots = moved.withColumnRenamed("to", "root")
        else:
            onward = moved.select(F.col("node").alias("root"), "to")
            before, roots = roots, stored(roots.join(onward, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
            dropped(before)
        a, b = (moved.select(F.col("node").alias(c), F.col("to").alias(f"{c}2")) for c in "ab")
        left = edges.join(a, "a").join(b, "b").filter("a2 <> b2")
        after = stored(left.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "links")
        dropped(edges)
        if not first:  # the first round's is the table of roots
            dropped(moved)
        edges = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots
