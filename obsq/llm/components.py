"""Connected components of a table of links, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsq.llm.common import cut, discard


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for every node of links(a, b), both long.

    Large-star and small-star steps in turn: each links a node's neighbours to the smallest of them, until every node
    hangs on the smallest node of its component. A node's neighbours are never gathered: only their minimum is.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    nodes = edges
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = cut(star.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if edges is not nodes:
            discard(edges)
        edges = new
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    root = edges.groupBy("u").agg(F.min("v").alias("component"))
    every = nodes.select(F.col("u").alias("node")).union(nodes.select(F.col("v").alias("node"))).distinct()
    out = cut(every.join(root.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("component", "node").alias("component")), "components")
    discard(nodes, edges)
    return out
