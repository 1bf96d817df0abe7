"""Components and degrees of an overlap graph, for one or many configurations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverscope.operators.scratch import cut


def both_ways(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    extra = [c for c in edges.columns if c not in ("a", "b", *keys)]
    return edges.select(*keys, F.col("a").alias("node"), F.col("b").alias("other"), *extra).unionByName(edges.select(*keys, F.col("b").alias("node"), F.col("a").alias("other"), *extra))


def components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, node and component (its smallest node).

    In each round every node joins its neighbour of the least hash, if that is below its own, and links between
    nodes that became one fall away. Chains of falling hashes are short, so nodes shrink several times a round
    whatever the graph's diameter."""
    keys = list(keys)
    ranked = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    links = cut(both_ways(edges.select(*keys, "a", "b"), keys).where("node <> other").select(*keys, ranked("node").alias("node"), ranked("other").alias("other")).distinct())
    labels = nodes.select(*keys, "node", ranked("node").alias("root"))
    while not links.isEmpty():
        up = links.groupBy(*keys, "node").agg(F.least("node", F.min("other")).alias("up"))
        for _ in range(2):
            over = up.select(*keys, F.col("node").alias("up"), F.col("up").alias("_next"))
            up = up.join(over, [*keys, "up"]).select(*keys, "node", F.col("_next").alias("up"))
        up = cut(up)
        of = lambda c: up.select(*keys, F.col("node").alias(c), F.col("up").alias("_up"))  # noqa: B023, E731
        labels = cut(labels.join(of("root"), [*keys, "root"], "left").select(*keys, "node", F.coalesce("_up", "root").alias("root")))
        for c in ("node", "other"):
            links = links.join(of(c), [*keys, c]).drop(c).withColumnRenamed("_up", c)
        links = cut(links.where("node <> other").distinct())
    least = labels.groupBy(*keys, "root").agg(F.min("node").alias("component"))
    return cut(labels.join(least, [*keys, "root"]).select(*keys, "node", "component"))


def context(nodes: DataFrame, edges: DataFrame, max_listed: int = 10_000) -> DataFrame:
    """node, degree, weighted_degree, strongest neighbour (the smaller id of equals) and neighbours.

    neighbours is null for a node with more than max_listed of them, so that no hub's ids stand in one
    value; both_ways has them all as rows."""
    both = both_ways(edges)
    per = both.groupBy("node").agg(
        F.count("*").alias("degree"),
        F.sum("strength").alias("weighted_degree"),
        F.min_by("other", F.struct(-F.col("strength"), "other")).alias("strongest"),
    )
    few = both.join(per.where(F.col("degree") <= max_listed).select("node"), "node", "left_semi")
    listed = few.groupBy("node").agg(F.array_join(F.array_sort(F.collect_list("other")), ",").alias("neighbours"))
    out = nodes.select("node").join(per, "node", "left").join(listed, "node", "left")
    return out.withColumns({"degree": F.coalesce("degree", F.lit(0)), "weighted_degree": F.coalesce("weighted_degree", F.lit(0))})


def degree_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    per = both_ways(edges).groupBy("node").agg(F.count("*").alias("d"))
    all_ = nodes.select("node").join(per, "node", "left").select(F.coalesce("d", F.lit(0)).alias("d"))
    return all_.agg((F.sum("d") / 2).cast("bigint").alias("n_edges"), F.count_if(F.col("d") == 0).alias("n_isolated"), F.min("d").alias("min_degree"), F.percentile("d", 0.5).alias("median_degree"), F.avg("d").alias("mean_degree"), F.max("d").alias("max_degree"))


def morans_i(values: DataFrame, edges: DataFrame, value: str = "value") -> DataFrame:
    """One row: n and Moran's I with row-standardised weights; isolates are left out, null if the value is constant. edges: a, b once each."""
    both = both_ways(edges)
    own = values.select("node", value).join(both.select("node").distinct(), "node", "left_semi")
    mean = own.agg(F.avg(value).alias("_m"))
    z = own.crossJoin(F.broadcast(mean)).select("node", (F.col(value) - F.col("_m")).alias("z"))
    lag = both.join(z.select(F.col("node").alias("other"), F.col("z").alias("_zo")), "other").groupBy("node").agg(F.avg("_zo").alias("lag"))
    return z.join(lag, "node").agg(F.count("*").alias("n"), (F.sum(F.col("z") * F.col("lag")) / F.nullif(F.sum(F.col("z") * F.col("z")), F.lit(0.0))).alias("morans_i"))
