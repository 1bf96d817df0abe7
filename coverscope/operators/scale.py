"""Scaling of numeric axes. Centres and scales come from one global aggregate, a single row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverscope.operators.scratch import cut


def with_stats(df: DataFrame, stats: Sequence[Column]) -> DataFrame:
    """df with global aggregates as columns."""
    return df.crossJoin(F.broadcast(df.agg(*stats)))


def z_score(df: DataFrame, columns: dict[str, str], digits: int | None = None) -> DataFrame:
    """df with each column centred and divided by its sample deviation; null where that is 0."""
    stats = [f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))]
    out = with_stats(df, stats)
    for c, new in columns.items():
        z = (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0))
        out = out.withColumn(new, z if digits is None else F.round(z, digits))
    return out.drop(*[f"_{n}_{c}" for c in columns for n in "ms"])


def places(df: DataFrame, column: str) -> DataFrame:
    """_v, _n and _upto: the distinct values of a column, their counts and how many rows have a value up to it; nulls are left out.

    The values are counted, range-partitioned and counted again by partition, so that no task sorts or holds all of them."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    ranged = cut(values.repartitionByRange("_v").withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.sum("_n").alias("_size"))
    offsets = sizes.select("_p", (F.sum("_size").over(Window.orderBy("_p")) - F.col("_size")).alias("_before"))  # a row for each partition
    within = F.sum("_n").over(Window.partitionBy("_p").orderBy("_v"))
    return ranged.join(F.broadcast(offsets), "_p").select("_v", "_n", (F.col("_before") + within).alias("_upto"))


#: Up to so many values of a column or a group are left to Spark's exact percentile in one task.
SMALL = 200_000
#: Accuracy of the approximate percentiles that bracket exact ones, and values inside all brackets that may be collected.
ACCURACY, INSIDE = 10_000, 1_000_000


def bracketed(values: DataFrame, n: int, levels: Sequence[float]) -> list[float] | None:
    """Exact type-7 quantiles of the n values of the column _v, from two scans and no shuffle of them; None if the brackets don't do.

    Approximate percentiles on either side of each level bracket its order statistics; the values
    below a bracket are counted, those inside it are collected with their counts."""
    ends = sorted({min(1.0, max(0.0, p + side * 2 / ACCURACY)) for p in levels for side in (-1, 1)})
    at = dict(zip(ends, values.agg(F.percentile_approx("_v", ends, ACCURACY)).first()[0], strict=True))
    boxes = [(at[max(0.0, p - 2 / ACCURACY)] if p > 2 / ACCURACY else float("-inf"), at[min(1.0, p + 2 / ACCURACY)] if p < 1 - 2 / ACCURACY else float("inf")) for p in levels]
    held = [F.col("_v").between(*b) for b in boxes]
    inside = reduce(lambda a, b: a | b, held)
    row = values.agg(F.count_if(inside).alias("inside"), *[F.count_if(F.col("_v") < b[0]).alias(f"below{i}") for i, b in enumerate(boxes)]).first()
    if row["inside"] > INSIDE:
        return None
    found = values.where(inside).groupBy("_v").agg(F.count("*").alias("c")).toPandas().sort_values("_v")
    out = []
    for i, (p, (lo, hi)) in enumerate(zip(levels, boxes, strict=True)):
        own = found[(found["_v"] >= lo) & (found["_v"] <= hi)]
        upto, h = own["c"].cumsum().to_numpy() + row[f"below{i}"], p * (n - 1)
        a, b = (int(np.searchsorted(upto, k, "right")) for k in (int(np.floor(h)), int(np.ceil(h))))
        if not len(own) or np.floor(h) < row[f"below{i}"] or b >= len(own):
            return None
        x, y = own["_v"].iloc[a], own["_v"].iloc[b]
        out.append(float(x + (y - x) * (h - np.floor(h))))
    return out


def quantiles(df: DataFrame, column: str, levels: Sequence[float], new: str = "quantiles") -> DataFrame:
    """One row with an array: the type-7 quantiles of a column at the levels, nulls where it has no values; exact at any size.

    Few values (counted) go to one percentile; many are bracketed; should that not do, they are read from the places of the values."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_v"))
    n = values.count()
    if n <= SMALL:
        none = F.array(*[F.lit(None).cast("double")] * len(levels))
        return values.agg(F.coalesce(F.percentile("_v", F.lit([float(p) for p in levels])), none).alias(new))
    found = bracketed(values, n, levels)
    if found is not None:
        return df.sparkSession.createDataFrame([(found,)], f"{new} array<double>")
    placed = places(df, column)
    rows = placed.crossJoin(F.broadcast(placed.agg((F.max("_upto") - 1).alias("_last"))))
    at = lambda i: F.min(F.when(F.col("_upto") > i, F.col("_v").cast("double")))
    ends = rows.agg(F.max("_last").alias("_last"), *[at(f(F.lit(p) * F.col("_last"))).alias(f"_{side}{i}") for i, p in enumerate(levels) for side, f in (("a", F.floor), ("b", F.ceil))])
    share = lambda p: F.lit(p) * F.col("_last") - F.floor(F.lit(p) * F.col("_last"))
    return ends.select(F.array(*[F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * share(p) for i, p in enumerate(levels)]).alias(new))


def group_quantiles(df: DataFrame, keys: Sequence[str], column: str, levels: Sequence[float], new: str = "quantiles", small: int = SMALL) -> DataFrame:
    """keys and an array: the type-7 quantiles of a column in each group with values (a null key is a group).

    Groups of up to `small` values go to percentile. The values of larger ones are counted, range-partitioned by
    (group, value) and placed by sums within and before the partitions, so no task holds a large group."""
    keys, levels = list(keys), [float(p) for p in levels]
    rows = df.select(*keys, F.col(column).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    direct = lambda x: x.groupBy(*keys).agg(F.percentile("_v", F.lit(levels)).alias(new))
    large = cut(rows.groupBy(*keys).agg(F.count("*").alias("_size")).where(F.col("_size") > small))
    if large.isEmpty():
        return direct(rows)
    named = [f"_k{i}" for i in range(len(keys))]
    large = large.withColumnsRenamed(dict(zip(keys, named, strict=True)))
    same = reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(keys, named, strict=True)])
    values = rows.join(large, same).groupBy(*named, "_size", "_v").agg(F.count("*").alias("_n"))
    ranged = cut(values.repartitionByRange(*named, "_v").withColumn("_p", F.spark_partition_id()))
    part = ranged.groupBy("_p", *named).agg(F.sum("_n").alias("_own"))
    before = part.select(F.struct("_p", *named).alias("_at"), (F.sum("_own").over(Window.partitionBy(*named).orderBy("_p")) - F.col("_own")).alias("_before"))  # a row for each partition of a group
    upto = F.sum("_n").over(Window.partitionBy("_p", *named).orderBy("_v"))
    placed = ranged.withColumn("_upto", upto).withColumn("_at", F.struct("_p", *named)).join(before, "_at").withColumn("_upto", F.col("_upto") + F.col("_before"))
    h = lambda p: F.lit(p) * (F.col("_size") - 1)
    at = lambda i: F.min(F.when(F.col("_upto") > i, F.col("_v")))
    ends = placed.groupBy(*named, "_size").agg(*[at(f(h(p))).alias(f"_{side}{i}") for i, p in enumerate(levels) for side, f in (("a", F.floor), ("b", F.ceil))])
    many = ends.select(*[F.col(a).alias(b) for a, b in zip(named, keys, strict=True)], F.array(*[F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (h(p) - F.floor(h(p))) for i, p in enumerate(levels)]).alias(new))
    return direct(rows.join(large, same, "left_anti")).unionByName(many)


def bracketed_medians(df: DataFrame, key: str, column: str, bins: int = 4096) -> DataFrame:
    """key and the exact median of a column in each of few groups, for values that are cheaper to make twice than to shuffle.

    One pass counts bins of equal width, and only the values in the bins that hold the two middle ones are moved and ordered."""
    rows = df.select(F.col(key), F.col(column).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    lo, hi = rows.agg(F.min("_v"), F.max("_v")).first()
    wide = (hi - lo) if lo is not None and hi > lo else 1.0
    rows = rows.withColumn("_bin", F.floor((F.col("_v") - F.lit(lo)) / wide * bins))
    order = Window.partitionBy(key).orderBy("_bin")
    counts = rows.groupBy(key, "_bin").agg(F.count("*").alias("_n")).withColumns({"_upto": F.sum("_n").over(order), "_size": F.sum("_n").over(Window.partitionBy(key))})
    middle = [F.floor((F.col("_size") - 1) / 2), F.floor(F.col("_size") / 2)]
    held = cut(counts.withColumn("_before", F.col("_upto") - F.col("_n")).where((F.col("_upto") > middle[0]) & (F.col("_before") <= middle[1])))  # two bins of a group at most
    values = rows.join(F.broadcast(held.select(key, "_bin", "_before", "_size")), [key, "_bin"]).groupBy(key, "_bin", "_before", "_size", "_v").agg(F.count("*").alias("_n"))
    placed = values.withColumn("_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy(key, "_bin").orderBy("_v")))
    at = lambda i: F.min(F.when(F.col("_upto") > i, F.col("_v")))
    return placed.groupBy(key).agg(((at(middle[0]) + at(middle[1])) / 2).alias("median"))


def with_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """df with quantiles as columns. wanted: new column to (column, level)."""
    out = df
    for new, (column, level) in wanted.items():
        out = out.crossJoin(F.broadcast(quantiles(df.select(column), column, [level]).select(F.col("quantiles")[0].alias(new))))
    return out


def average_rank(df: DataFrame, column: str, new: str) -> DataFrame:
    """df with the rank of a column, ties at their mean; nulls have none."""
    ranks = places(df, column).select("_v", (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).alias(new))
    return df.join(ranks, F.col(column) == F.col("_v"), "left").drop("_v")


def mad(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with each column less its median, divided by 1.4826 times the median absolute deviation; null where that is 0."""
    out = with_quantiles(df, {f"_m_{c}": (c, 0.5) for c in columns})
    for c in columns:
        out = out.withColumn(f"_d_{c}", F.abs(F.col(c) - F.col(f"_m_{c}")))
    out = with_quantiles(out, {f"_s_{c}": (f"_d_{c}", 0.5) for c in columns})
    for c, new in columns.items():
        out = out.withColumn(new, (F.col(c) - F.col(f"_m_{c}")) / F.nullif(1.4826 * F.col(f"_s_{c}"), F.lit(0.0)))
    return out.drop(*[f"_{n}_{c}" for c in columns for n in "mds"])


def rank_score(df: DataFrame, column: str, new: str) -> DataFrame:
    return z_score(average_rank(df, column, "_rank"), {"_rank": new}).drop("_rank")


def nor_legacy(df: DataFrame, column: str, new: str) -> DataFrame:
    """x - min / (max - min), as written: division first."""
    out = with_stats(df, [F.min(column).alias("_lo"), F.max(column).alias("_hi")])
    return out.withColumn(new, F.col(column) - F.col("_lo") / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))).drop("_lo", "_hi")


def min_max(df: DataFrame, column: str, new: str) -> DataFrame:
    out = with_stats(df, [F.min(column).alias("_lo"), F.max(column).alias("_hi")])
    return out.withColumn(new, (F.col(column) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))).drop("_lo", "_hi")


def quartile_flags(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """df with <column>_high or <column>_low for each column of spec ('high': in the top quartile), and all_flags for all of them at once."""
    out = with_quantiles(df, {f"_q_{c}": (c, 0.75 if side == "high" else 0.25) for c, side in spec.items()})
    both = F.lit(True)
    for c, side in spec.items():
        flag = F.col(c) >= F.col(f"_q_{c}") if side == "high" else F.col(c) <= F.col(f"_q_{c}")
        out = out.withColumn(f"{c}_{side}", flag)
        both = both & F.col(f"{c}_{side}")
    return out.withColumn("all_flags", both).drop(*[f"_q_{c}" for c in spec])


def one_hot(df: DataFrame, column: str, max_levels: int = 1000) -> DataFrame:
    """df with a 0/1 column for each level; more than max_levels levels are an error."""
    levels = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(max_levels + 1).collect()]
    if len(levels) > max_levels:
        raise ValueError(f"{column} has more than {max_levels} levels")
    return df.withColumns({f"{column}_{v}": F.when(F.col(column) == v, 1).otherwise(0) for v in sorted(levels)})
