"""Connected components of tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.sources import scratch


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of an edge (a, b) can reach; nodes of any orderable type.

    Stars are made smaller by turns: a node's larger neighbours move to its smallest one, then its smaller ones do. Every
    round is a few aggregates over at most as many edges and is written, so no plan grows and no executor's loss repeats
    more than a round. An edge with a null end is left out, loops count for their node. Raises rather than stop early.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null")
    every = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    now = scratch.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        around = now.union(now.select("b", "a"))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select("b", "m").union(least).toDF("a", "b").distinct()
        small = scratch.written(small, "edges")
        # stars: each node has one edge, to a node that has none
        apart = small.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a").union(small.select("b").distinct().join(small.select("a").distinct(), F.col("b") == F.col("a"), "left_semi"))
        now = small
        if not apart.limit(1).count():
            break
    else:
        raise RuntimeError(f"components: not done after {rounds} rounds")
    return every.join(now, every["node"] == now["a"], "left").select("node", F.coalesce("b", "node").alias("component"))
