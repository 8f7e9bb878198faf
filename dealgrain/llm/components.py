"""Connected components of a link table, with neither a collected group nor a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def _stars(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = both.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.where("a < b").distinct()


def _small_stars(edges: DataFrame) -> DataFrame:
    """Hang the smaller neighbours of a node, and the node itself, on the smallest of them."""
    low = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(low, "b").select("m", F.explode(F.array("a", "b")).alias("n"))
    return moved.where("m < n").select(F.col("m").alias("a"), F.col("n").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and label: each linked node with the smallest node of its component.

    ``links`` has columns a and b of any ordered type. Alternating star steps shorten every path to length one in
    a number of rounds that grows with the logarithm of the longest path; each round is stored.
    """
    ordered = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges, before = materialise(ordered, "edges"), None
    while True:
        edges = materialise(_small_stars(_stars(edges)), "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    ends = edges.select(F.col("b").alias("node"), F.col("a").alias("label"))
    return ends.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
