"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = common.materialize(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low")), "least")
    return both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = common.materialize(down.groupBy("src").agg(F.min("dst").alias("low")), "least")
    moved = down.join(least, "src").where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return moved.unionByName(least.select("src", F.col("low").alias("dst")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(src, dst)``, longs, to ``(node, component)`` for every node that has an edge; component is its least node.

    Minima are aggregated before a shuffle and written, so both sides of the joins are plain shuffles: Spark splits a node of very many
    links among tasks, which it doesn't where one side is an aggregate.  Each round is written to the shared folder.  The number of rounds grows with the logarithm of the longest path.
    """
    now = common.materialize(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        now = common.materialize(_small_star(_large_star(now)).distinct(), "edges")
        # the sum of hashes tells whether the set of edges has changed
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")), F.sum(F.col("dst").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
