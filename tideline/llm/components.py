"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: each node's neighbours (the larger ones, or the smaller ones and itself) join its least."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    # in edges, a > b; a small star sees the smaller neighbours only
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    seen = both.join(least, "a")
    if large:
        made = seen.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        made = seen.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return made.where("a > b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a and b), the component its least node.

    The number of rounds grows with the logarithm of the longest path. Only a count and a checksum of
    the edges reach the driver.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    edges, before = staged(edges, name), None
    while True:
        last, edges = edges, staged(_star(_star(edges, large=True), large=False), name)
        unstage(last)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    least = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(least)
