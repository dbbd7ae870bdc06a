"""Connected components by alternating stars, as joins and minima on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; every row is (node, smaller node)."""
    least = _both_ways(edges).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    # Both steps leave pairs whose first node is the larger.
    rising = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    large = rising.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    joined = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
    # Not a union of two selections: that plans all of the above twice, in the driver's memory.
    small = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return small.where("a <> b").distinct()


def contract(edges: DataFrame, rounds: int) -> DataFrame:
    """Edges ``(a, b)``, ``b`` smaller, of the same components after some rounds; most are stars by then."""
    # Each round reads its edges several times, so they are written first.
    now = materialize(edges.where("a <> b").select("a", "b"), "edges")
    for _ in range(rounds):
        now = materialize(_stars(now), "edges")
    return now


def known_labels(stars: DataFrame) -> DataFrame:
    """``(node, label)`` of the nodes that :func:`contract` linked to a smaller one; equal labels are surely one component."""
    return stars.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges(a, b)``; the label is the smallest node that can be reached.

    Each round ends in a written table, so a lost executor repeats one round at most. A node with very many edges is
    reduced by partial minima and joined, never gathered.
    """
    now = contract(edges, 1)
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or state["n"] == 0:
            break
        seen = state
        now = materialize(_stars(now), "edges")
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return leaves.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
