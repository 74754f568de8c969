"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node with the smallest of them.

    ``edges`` has (u, v) with u > v. The large step moves a node's larger neighbours, the small step
    its smaller ones and the node itself. The smallest neighbour is a partial aggregate, and a node
    with very many neighbours meets it in a join, which adaptive execution can split.
    """
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Component of every node that has an edge: (node, component), the component being its smallest node.

    ``edges``: columns u and v of one orderable type, in any direction; loops and nulls are ignored.
    No edges give no rows. Each round is written to the shared folder, so the lineage stays short.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(edges, "edges")
    signature = None
    for _ in range(rounds):
        edges = written(_star(_star(edges, True), False), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == signature:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        signature = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
