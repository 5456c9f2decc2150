"""Connected components by alternating large-star and small-star steps over a table of links.

Every step is a join and an aggregate; links are staged in the shared folder between steps, and nothing but two sums
per step reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesift.llm.stage import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where(F.col("b") < F.col("a"))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    if large:
        moved = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node that it reaches) for the nodes of ``links`` (long columns a, b)."""
    edges = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    state = None
    while True:
        edges = stage(_star(_star(edges, True), False), "links")
        now = edges.agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
