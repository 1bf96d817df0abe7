"""Pairs of balls with similar scores but different profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverscope.functions.columns import squared
from coverscope.operators.joins import pairs


def score(axes: Sequence[str], weights: Sequence[float | Column] | None = None) -> Column:
    weights = weights or [1 / len(axes)] * len(axes)
    out = F.lit(0.0)
    for a, w in zip(axes, weights, strict=True):
        out = out + F.col(a) * w
    return out


def contrasts(balls: DataFrame, axes: Sequence[str], edges: DataFrame | None = None, gap: float = 0.25, distance: float = 1.0, sign: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of balls with score gap, axis distance, distance of the centred profiles, sign disagreements, adjacency, and the candidate flag (gap at most, centred distance at least)."""
    scored = balls.select(*by, "ball_id", *axes, score(axes).alias("score"))
    p = pairs(scored, "ball_id", by)
    centred = [([F.col(f"{a}_{s}") - F.col(f"score_{s}") for a in axes]) for s in "ab"]
    disagree = F.lit(0)
    for a in axes:
        x, y = F.col(f"{a}_a"), F.col(f"{a}_b")
        disagree = disagree + F.when((F.abs(x) > sign) & (F.abs(y) > sign) & (F.signum(x) != F.signum(y)), 1).otherwise(0)
    out = p.select(
        *by,
        F.col("ball_id_a").alias("a"),
        F.col("ball_id_b").alias("b"),
        F.abs(F.col("score_a") - F.col("score_b")).alias("score_gap"),
        F.sqrt(squared([F.col(f"{a}_a") for a in axes], [F.col(f"{a}_b") for a in axes])).alias("axis_distance"),
        F.sqrt(squared(*centred)).alias("profile_distance"),
        disagree.alias("sign_disagreements"),
    )
    out = out.withColumn("candidate", (F.col("score_gap") <= gap) & (F.col("profile_distance") >= distance))
    return out if edges is None else out.join(edges, [*by, "a", "b"], "left").withColumn("strength", F.coalesce("strength", F.lit(0)))


def threshold_grid(found: DataFrame, gaps: Sequence[float], distances: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """gap, distance, n_pairs and n_qualifying (gap below, axis distance above, both strictly) for each group.

    Each pair falls into one bin of a histogram (the first gap that lets it pass, the number of distances it
    exceeds); the counts of all cells are sums over the bins, so pairs aren't multiplied by cells."""
    gaps, distances = sorted(float(g) for g in gaps), sorted(float(x) for x in distances)
    first = F.lit(len(gaps))
    for i, g in reversed(list(enumerate(gaps))):
        first = F.when(F.col("score_gap") < g, i).otherwise(first)
    beyond = sum((F.when(F.col("axis_distance") > x, 1).otherwise(0) for x in distances), F.lit(0))
    bins = found.groupBy(*by, first.alias("_g"), beyond.alias("_x")).agg(F.count("*").alias("_n"))
    cell = lambda i, j: F.sum(F.when((F.col("_g") <= i) & (F.col("_x") > j), F.col("_n")).otherwise(0))
    cells = [F.struct(F.lit(g).alias("gap"), F.lit(x).alias("distance"), F.sum("_n").alias("n_pairs"), cell(i, j).alias("n_qualifying")) for i, g in enumerate(gaps) for j, x in enumerate(distances)]
    return bins.groupBy(*by).agg(F.array(*cells).alias("_r")).select(*by, F.inline("_r"))


SPREAD = {"median": 0.5, "q10": 0.1, "q90": 0.9}


def spread(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Of each group: n_runs, and median, q10, q90, least and largest of each column."""
    return rows.groupBy(*by).agg(F.count("*").alias("n_runs"), *[F.percentile(c, p).alias(f"{c}_{n}") for c in columns for n, p in SPREAD.items()], *[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def robustness_cells(cells: DataFrame) -> DataFrame:
    """cells (radius, replicate, gap, distance, n_pairs, n_qualifying) to the spread over the replicates, and the share of runs with a qualifying pair."""
    rows = cells.withColumn("prevalence", F.col("n_qualifying") / F.col("n_pairs"))
    some = rows.groupBy("radius", "gap", "distance").agg(F.avg((F.col("n_qualifying") > 0).cast("double")).alias("share_any"))
    return spread(rows, ["radius", "gap", "distance"], ["n_qualifying", "prevalence"]).join(some, ["radius", "gap", "distance"])


def robustness_overall(runs: DataFrame) -> DataFrame:
    """metric and value over all covers: how many, share of orders with a qualifying pair at every radius, and least, median and largest prevalence."""
    every = runs.groupBy("replicate").agg(F.every(F.col("n_qualifying") > 0).alias("all")).agg(F.avg(F.col("all").cast("double")).alias("share_of_orders_nonzero_at_all_radii"))
    one = runs.agg(F.count("*").cast("double").alias("covers"), F.min("prevalence").alias("prevalence_min"), F.percentile("prevalence", 0.5).alias("prevalence_median"), F.max("prevalence").alias("prevalence_max")).crossJoin(every)
    return one.unpivot([], one.columns, "metric", "value")


def weight_subsets(sensitivity: DataFrame, least: Sequence[float], distances: Sequence[float]) -> DataFrame:
    """least_weight, distance, n_schemes and least, median and largest number of qualifying pairs over the schemes whose weights are all at least so large."""
    bounds = F.explode(F.array(*[F.lit(float(x)) for x in least])).alias("bound")
    rows = sensitivity.select("*", bounds).where(F.col("least_weight") >= F.col("bound"))
    long_ = rows.unpivot(["bound"], [f"n_{d:g}" for d in distances], "_d", "n").withColumn("distance", F.substring("_d", 3, 9).cast("double"))
    return long_.groupBy(F.col("bound").alias("least_weight"), "distance").agg(F.count("*").alias("n_schemes"), F.min("n").alias("n_min"), F.percentile("n", 0.5).alias("n_median"), F.max("n").alias("n_max"))


def weight_simplex(spark, step: float = 0.05) -> DataFrame:
    """scheme, w1, w2, w3: all weights in whole steps with sum 1."""
    n = round(1 / step)
    i = spark.range(n + 1).withColumnRenamed("id", "i")
    j = spark.range(n + 1).withColumnRenamed("id", "j")
    w = i.crossJoin(F.broadcast(j)).where(F.col("i") + F.col("j") <= n)
    return w.select((F.col("i") * (n + 1) + F.col("j")).alias("scheme"), (F.col("i") / n).alias("w1"), (F.col("j") / n).alias("w2"), ((n - F.col("i") - F.col("j")) / n).alias("w3"))


def weighted_pairs(balls: DataFrame, axes: Sequence[str], schemes: DataFrame) -> DataFrame:
    """scheme, weights, a, b, score_gap under the scheme, and axis distance."""
    p = pairs(balls.select("ball_id", *axes), "ball_id").crossJoin(F.broadcast(schemes))
    d = [F.col(f"{a}_a") - F.col(f"{a}_b") for a in axes]
    gap = F.abs(d[0] * F.col("w1") + d[1] * F.col("w2") + d[2] * F.col("w3"))
    return p.select("scheme", "w1", "w2", "w3", F.col("ball_id_a").alias("a"), F.col("ball_id_b").alias("b"), F.round(gap, 9).alias("score_gap"), F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("axis_distance"))


def weight_sensitivity(weighted: DataFrame, gap: float, distances: Sequence[float]) -> DataFrame:
    """scheme, least weight, and qualifying pairs at each distance."""
    least = F.round(F.least("w1", "w2", "w3"), 6)
    return weighted.groupBy("scheme", least.alias("least_weight")).agg(*[F.count_if((F.col("score_gap") < gap) & (F.col("axis_distance") > d)).alias(f"n_{d:g}") for d in distances])


def pair_frequency(weighted: DataFrame, gap: float, distance: float, least: float = 0.2) -> DataFrame:
    """a, b and the share of the balanced schemes in which the pair qualifies."""
    balanced = weighted.where(F.round(F.least("w1", "w2", "w3"), 6) >= least)
    return balanced.groupBy("a", "b").agg(F.avg(((F.col("score_gap") < gap) & (F.col("axis_distance") > distance)).cast("double")).alias("frequency"))


def nearest_comparators(found: DataFrame) -> DataFrame:
    """Of each ball: the ball nearest by score and the one nearest by profile, the smaller id of equals."""
    both = found.select(F.col("a").alias("ball_id"), F.col("b").alias("other"), "score_gap", "axis_distance").unionByName(found.select(F.col("b").alias("ball_id"), F.col("a").alias("other"), "score_gap", "axis_distance"))
    first = lambda c: F.min_by("other", F.struct(F.round(c, 9), "other"))
    return both.groupBy("ball_id").agg(first("score_gap").alias("nearest_by_score"), first("axis_distance").alias("nearest_by_profile"))
