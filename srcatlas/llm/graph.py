"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(src long, dst long) to (node, root): root is the smallest node that can be reached. Only nodes with an edge appear.

    Each round takes minima by partial aggregation and a join, never a list of a node's neighbours, and is written to the
    shared folder, so a hub with a third of all edges is only a skewed join. Ends when the edges are stars around roots.
    """
    big, small = F.greatest("src", "dst"), F.least("src", "dst")
    now = written(edges.filter("src <> dst").select(big.alias("u"), small.alias("v")).distinct(), "edges")
    last = None
    for _ in range(most_rounds):
        # Large star: every larger neighbour of x moves to the smallest of x and its neighbours.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: x and its smaller neighbours move to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small_star = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        new = written(small_star, "edges")
        # Stars: every node has one smaller neighbour, and that one has none.
        open_ = new.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count() or new.join(new.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        if last is not None:
            forget(last)
        last, now = now, new
        if not open_:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
