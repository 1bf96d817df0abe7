"""Ordered covers by balls of one radius.

Walking the units in order, the first one that no ball covers becomes a landmark; its ball
holds all units within the radius. Whether a unit becomes one depends on earlier units within
the radius alone, so many decide at once: in each round the first `head` uncovered units are
walked, and beyond them every unit that comes first in its grid cell and in all cells around it
(cells as wide as the radius) is a landmark too. So rounds follow the longest chain of cells
that wait for each other, not the number of units. sweep.py has many covers of one table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverscope.functions.columns import squared
from coverscope.operators.bins import canonical_order
from coverscope.operators.near import MAX_BROADCAST, within_radius
from coverscope.operators.scratch import cut
from coverscope.operators.sweep import Sweep


def order_key(item: str, seed: int | Column) -> Column:
    """A random order of units for a seed, the same in every engine with md5."""
    return F.md5(F.concat_ws(":", F.col(item).cast("string"), F.lit(seed).cast("string") if isinstance(seed, int) else seed.cast("string")))


def landmarks(points: DataFrame, axes: Sequence[str], item: str = "id", order: str | None = None, eps: str = "eps", head: int = 2048) -> DataFrame:
    """landmark, ball_id (1 is the first), eps and the axes as c_<axis>, for points with a column eps that is the same in all rows."""
    axes = list(axes)
    at = [f"_cell{i}" for i in range(min(len(axes), 3))]  # some axes will do: points near each other are near on each axis
    schema = points.select(F.col(item).alias("landmark"), F.col(order or item).alias("_ord"), F.col(eps).alias("eps"), *[F.col(a).alias(f"c_{a}") for a in axes]).schema
    left = points.select(item, F.col(order or item).alias("_ord"), F.col(eps).alias("eps"), *axes).withColumns({c: F.floor(F.col(a) / F.col(eps)) for c, a in zip(at, axes)})
    found, n_left, n_found, walks = None, left.count(), 0, 0

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_ord", item], ignore_index=True)
        x, e2 = pdf[axes].to_numpy(float), float(pdf["eps"].iloc[0]) ** 2
        free, own = np.ones(len(x), bool), []
        for i in range(len(x)):
            if free[i]:
                own.append(i)
                free &= ~(((x - x[i]) ** 2).sum(axis=1) <= e2)
        out = pdf.iloc[own]
        return out.rename(columns={item: "landmark"} | {a: f"c_{a}" for a in axes})[schema.names]

    def around(df: DataFrame) -> DataFrame:
        """df once for each of the cells around its own."""
        for c in at:
            df = df.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
        return df

    while n_left:
        new = left.orderBy("_ord", item).limit(head).groupBy().applyInPandas(walk, schema)
        if n_left > head and walks:  # few large balls need no more than the first walk
            first = cut(left.groupBy(*at).agg(F.min(F.struct("_ord", F.col(item).alias("landmark"), "eps", *[F.col(a).alias(f"c_{a}") for a in axes])).alias("_first")))
            earliest = around(first.select(*at, F.struct("_first._ord", "_first.landmark").alias("_rank"))).groupBy(*at).agg(F.min("_rank").alias("_rank"))
            alone = first.join(earliest, at).where(F.struct("_first._ord", "_first.landmark") == F.col("_rank")).select("_first.*").select(*schema.names)
            new = new.unionByName(alone).dropDuplicates(["landmark"])
        new = cut(new)
        found, walks, n = new if found is None else found.unionByName(new), walks + 1, new.count()
        n_found += n
        if n_left <= head:
            break
        covering = around(new.select(F.col("eps").alias("_eps"), *[f"c_{a}" for a in axes], *[F.floor(F.col(f"c_{a}") / F.col("eps")).alias(c) for c, a in zip(at, axes)])).withColumnsRenamed({c: f"_{c}" for c in at})
        near = squared([F.col(a) for a in axes], [F.col(f"c_{a}") for a in axes]) <= F.col("_eps") * F.col("_eps")
        for c in at:
            near = near & (F.col(c) == F.col(f"_{c}"))
        left = cut(left.join(F.broadcast(covering) if n * 3 ** len(at) <= MAX_BROADCAST * 10 else covering, near, "left_anti"))
        n_left = left.count()
    if found is None:
        return points.sparkSession.createDataFrame([], schema).withColumn("ball_id", F.lit(0).cast("bigint")).drop("_ord")
    if n_found <= MAX_BROADCAST:  # counted: one task may number them
        numbered = found.withColumn("ball_id", F.row_number().over(Window.orderBy("_ord", "landmark")))
    else:
        numbered = canonical_order(found, [F.col("_ord"), F.col("landmark")], "ball_id")
    return numbered.withColumn("ball_id", F.col("ball_id").cast("bigint")).drop("_ord")


def members(points: DataFrame, balls: DataFrame, axes: Sequence[str], item: str = "id") -> DataFrame:
    """ball_id, landmark and unit for all units of each ball. balls: as landmarks() gives them."""
    p = points.select(F.col(item).alias("unit"), *axes)
    cell = balls.agg(F.max("eps")).first()[0]
    return within_radius(p, balls, axes, [f"c_{a}" for a in axes], F.col("eps"), cell=cell).select("ball_id", "landmark", "unit")


def build_cover(points: DataFrame, axes: Sequence[str], eps: float, item: str = "id", order: str | None = None, head: int = 2048) -> tuple[DataFrame, DataFrame]:
    """(balls, membership) of one cover."""
    p = points.withColumn("eps", F.lit(float(eps)))
    balls = cut(landmarks(p, axes, item, order, head=head))
    return balls, cut(members(points, balls, axes, item))


def cover_grid(points: DataFrame, axes: Sequence[str], radii: Sequence[float], replicates: Sequence[int], item: str = "id", seed: int = 20260807, step: int = 1009) -> tuple[DataFrame, DataFrame]:
    """(balls, membership) with the keys radius and replicate, of a few covers whose members are wanted as rows; see sweep.Sweep for many."""
    swept = Sweep(points, axes, radii, replicates, item, seed, step)
    return swept.balls(), cut(swept.members())


def sizes(membership: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return membership.groupBy(*keys, "ball_id").agg(F.count("*").alias("ball_size"))


def edges(membership: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """a < b and strength, the number of shared units. A unit's balls make pairs: their number is bounded by the packing of the space, not by the data."""
    a = membership.select(*keys, "unit", F.col("ball_id").alias("a"))
    b = membership.select(*keys, "unit", F.col("ball_id").alias("b"))
    return a.join(b, [*keys, "unit"]).where("a < b").groupBy(*keys, "a", "b").agg(F.count("*").alias("strength"))


def ball_means(membership: DataFrame, values: DataFrame, item: str, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The mean of each value over the members of each ball; nulls are left out."""
    joined = membership.join(values.select(F.col(item).alias("unit"), *columns), "unit")
    return joined.groupBy(*keys, "ball_id").agg(*[F.avg(c).alias(c) for c in columns])


def local_colour(membership: DataFrame, values: DataFrame, item: str, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Of each unit: the mean, over its balls, of the balls' means (null balls left out), and how many balls it is in."""
    means = ball_means(membership, values, item, columns, keys)
    return membership.join(means, [*keys, "ball_id"]).groupBy(*keys, "unit").agg(F.count("*").alias("n_balls"), *[F.avg(c).alias(c) for c in columns])


def check_cover(points: DataFrame, balls: DataFrame, membership: DataFrame, item: str = "id") -> DataFrame:
    """check and passed: nonempty, all units covered, known units only, one landmark for each ball, landmarks in their balls."""
    units = points.select(F.col(item).alias("unit"))
    uncovered = units.join(membership.select("unit"), "unit", "left_anti").agg((F.count("*") == 0).alias("all_covered"))
    unknown = membership.join(units, "unit", "left_anti").agg((F.count("*") == 0).alias("known_units"))
    own = balls.agg((F.count("*") > 0).alias("nonempty"), (F.count("*") == F.count_distinct("landmark")).alias("one_landmark"))
    inside = balls.join(membership.where("landmark = unit").select("ball_id"), "ball_id", "left_anti").agg((F.count("*") == 0).alias("landmark_inside"))
    one = own.crossJoin(uncovered).crossJoin(unknown).crossJoin(inside)
    return one.unpivot([], one.columns, "check", "passed")


def fingerprint(balls: DataFrame, membership: DataFrame, edge: DataFrame) -> DataFrame:
    """sha256 of the number and the summed hashes of the balls' texts (landmark, number and summed hashes of the members) and of the edges' texts.

    Sums don't depend on the order of rows, so nothing is gathered."""
    hashed = lambda x: F.sum(F.conv(F.substring(F.sha2(x.cast("string"), 256), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    ball = membership.groupBy("ball_id", "landmark").agg(F.count("*").alias("n"), hashed(F.col("unit")).alias("h"))
    lines = ball.select(F.concat_ws("|", F.lit("BALL"), "ball_id", "landmark", "n", "h").alias("line"))
    lines = lines.unionByName(edge.select(F.concat_ws("|", F.lit("EDGE"), "a", "b", "strength").alias("line")))
    return lines.agg(F.sha2(F.concat_ws("|", F.count("*"), hashed(F.col("line"))), 256).alias("fingerprint"))


def covers_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows of either membership the other one lacks."""
    left = a.select("landmark", "unit").exceptAll(b.select("landmark", "unit")).agg(F.count("*").alias("only_a"))
    right = b.select("landmark", "unit").exceptAll(a.select("landmark", "unit")).agg(F.count("*").alias("only_b"))
    return left.crossJoin(right).withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def compare_covers(a: DataFrame, b: DataFrame) -> DataFrame:
    """landmark, and how many of its members both memberships have, and either alone; a row for each landmark of either."""
    side = lambda m, name: m.select("landmark", "unit", F.lit(1).alias(name))
    both = side(a, "_a").join(side(b, "_b"), ["landmark", "unit"], "full")
    x, y = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return both.groupBy("landmark").agg(F.count_if(x & y).alias("n_both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"))
