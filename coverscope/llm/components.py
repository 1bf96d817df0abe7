"""Connected components of an edge table, by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverscope.llm.shared import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (large) or smaller (small) neighbours, tied to the smallest node of its neighbourhood."""
    if large:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    tied = edges.join(least, "a")
    if large:
        tied = tied.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        tied = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return tied.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: a and b of one type. node and component, the smallest node of it, for the nodes that have an edge to another one.

    Rounds grow with the logarithm of a component's length; each is written to the shared
    folder. The driver sees a count and a checksum of each round.
    """
    edges = written(edges.where("a <> b").distinct(), "edges")
    before = None
    while True:
        edges = written(_stars(_stars(edges, large=True), large=False), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
