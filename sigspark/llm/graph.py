"""Connected components of links that stay in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b): the smallest node it reaches.

    Each round takes the smallest label among a node's neighbours and then the label of that label, so long chains
    shorten by more than half. Labels live in written tables; only the count of changed labels comes to the driver.
    Joins are sort-merge joins that adaptive execution can split, so a node with very many links is no single task.
    """
    both = scratch.save(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-links")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), f"{name}-0")
    for i in range(1, rounds):
        near = both.join(labels.withColumnRenamed("node", "b").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        least = labels.join(near.hint("merge"), "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        moved = least.join(jump.hint("merge"), "mid").select("node", F.least("mid", "far").alias("component"), (F.least("mid", "far") != F.col("old")).alias("moved"))
        new = scratch.save(moved, f"{name}-{i}")
        done = new.where("moved").limit(1).count() == 0
        scratch.drop(f"{name}-{i - 1}")
        labels = new.select("node", "component")
        if done:
            scratch.drop(f"{name}-links")
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
