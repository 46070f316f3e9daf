"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moorage.llm.base import settle, settled_for_now


def components(links: DataFrame, *, most_rounds: int = 50) -> DataFrame:
    """node, component (the least node reachable) for every node of ``links`` (left, right); other nodes: none.

    Alternates large-star and small-star steps: each hangs the neighbours of a node under the least of them,
    larger ones first, then smaller ones. Every round is an aggregation to the least neighbour (combined
    before its shuffle) and a join, so a node with many links is no hot key, and takes as many rows as there are
    links. Tables are settled between rounds, so a lost executor costs one round. It ends with a round that changes
    nothing, after about log of the longest chain; beyond ``most_rounds`` it raises. Nothing reaches the
    driver but two sums.
    """
    ordered = links.where("left <> right").select(F.greatest("left", "right").alias("node"), F.least("left", "right").alias("to"))
    edges = settle(ordered.distinct())
    before = None
    for _ in range(most_rounds):
        with settled_for_now(links.sparkSession) as hand_over:
            edges = hand_over(_star(settle(_star(edges, larger=True)), larger=False))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "to").cast("decimal(38,0)"))).first()
        if now == before:
            roots = edges.select(F.col("to").alias("node"), F.col("to").alias("component")).distinct()
            return edges.select("node", F.col("to").alias("component")).union(roots)
        before = now
    raise RuntimeError(f"links not resolved in {most_rounds} rounds")


def _star(edges: DataFrame, *, larger: bool) -> DataFrame:
    """Edges (node, to) with to < node, each neighbour hung under the least of the node and its neighbours.

    ``larger``: the neighbours that are larger than the node; else the smaller ones and the node itself.
    """
    if larger:
        both = edges.union(edges.select(F.col("to").alias("node"), F.col("node").alias("to")))
        least = both.groupBy("node").agg(F.min("to").alias("low")).select(F.col("node").alias("of"), F.least("node", "low").alias("low"))
        least = settle(least)  # so the join is of two plain exchanges and may split a node with many links
        kept = edges.select(F.col("to").alias("centre"), F.col("node").alias("leaf"))
        hung = kept.join(least, F.col("centre") == F.col("of")).select(F.col("leaf").alias("node"), F.col("low").alias("to"))
    else:
        least = settle(edges.groupBy("node").agg(F.min("to").alias("low")).withColumnRenamed("node", "of"))
        hung = edges.join(least, F.col("node") == F.col("of")).select(F.col("to").alias("node"), F.col("low").alias("to")).where("node <> to")
        hung = hung.union(least.select(F.col("of").alias("node"), F.col("low").alias("to")))
    return hung.distinct()
