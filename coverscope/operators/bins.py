"""Binning, ranking inside groups and crossings of curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverscope.operators.scale import group_quantiles, quantiles
from coverscope.operators.scratch import cut


def quantile_bins(df: DataFrame, x: str, n: int = 10, new: str = "bin", by: Sequence[str] = ()) -> DataFrame:
    """df with the number of the interval (lowest, b1], (b1, b2] ... between the distinct type-7 quantiles; the least value is in the first."""
    levels = [i / n for i in range(n + 1)]
    if by:
        out = df.join(group_quantiles(df, by, x, levels, "_breaks").withColumn("_breaks", F.array_distinct("_breaks")), list(by))
    else:
        out = df.crossJoin(F.broadcast(quantiles(df, x, levels, "_breaks").select(F.array_distinct("_breaks").alias("_breaks"))))
    above = F.size(F.filter(F.slice("_breaks", 2, n), lambda b: F.col(x) > b))
    return out.withColumn(new, F.when(F.col(x).isNotNull(), F.least(above + 1, F.greatest(F.size("_breaks") - 1, F.lit(1))))).drop("_breaks")


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= n).withColumnRenamed("_k", "rank")


def nearest_row(df: DataFrame, by: Sequence[str], x: str, target: float) -> DataFrame:
    """Of each group the row whose x is nearest to the target, the smaller x of equals."""
    return top_n(df, by, [F.abs(F.col(x) - target), F.col(x)], 1).drop("rank")


def canonical_order(df: DataFrame, item: str | Sequence[Column], new: str = "point_index") -> DataFrame:
    """df with the place (from 1) of each row by id or by several sort columns: a range partition each, counted and offset, so that no task sorts all rows."""
    order = [item] if isinstance(item, str) else list(item)
    ranged = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return ranged.join(F.broadcast(offsets), "_p").withColumn(new, F.col("_before") + F.row_number().over(Window.partitionBy("_p").orderBy(*order))).drop("_p", "_before")


def prefix_scan(df: DataFrame, order: Sequence[str], states: dict[str, tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """df with running values along an order, in each group of `by`. states: new column to ('last', column), the last value that is not null, or ('sum', column).

    Rows are range-partitioned by group and order. Each partition folds its own rows, its end
    state goes on to the later partitions (one row for each partition of a group), and rows add
    what came before; no task sees all rows of a long group."""
    order, by = list(order), list(by)
    ranged = cut(df.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()))
    so_far = Window.partitionBy("_p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct("_p", *by)  # equal also where a key of the group is null
    ends = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_e{i}") if how == "last" else F.sum(c).alias(f"_e{i}") for i, (how, c) in enumerate(states.values())]
    carries = [F.last(f"_e{i}", ignorenulls=True).over(earlier).alias(f"_c{i}") if how == "last" else F.sum(f"_e{i}").over(earlier).alias(f"_c{i}") for i, (how, _) in enumerate(states.values())]
    carried = ranged.groupBy("_p", *by).agg(*ends).select(at.alias("_at"), *carries)
    out = ranged.withColumn("_at", at)
    for i, (how, c) in enumerate(states.values()):
        out = out.withColumn(f"_w{i}", (F.last(c, ignorenulls=True) if how == "last" else F.sum(c)).over(so_far))
    out = out.join(carried, "_at")
    new = {name: F.coalesce(f"_w{i}", f"_c{i}") if how == "last" else F.coalesce(F.col(f"_w{i}") + F.col(f"_c{i}"), f"_w{i}", f"_c{i}") for i, (name, (how, _)) in enumerate(states.items())}
    return out.withColumns(new).drop("_p", "_at", *[f"_{x}{i}" for x in "wc" for i in range(len(states))])


def first_crossing(curve: DataFrame, x: str, y: str, target: float) -> DataFrame:
    """crossing and status of the first point where y reaches the target, interpolated in log x. curve: a row for each grid point."""
    w = Window.orderBy(x)
    rows = curve.withColumns({"_x0": F.lag(x).over(w), "_y0": F.lag(y).over(w)}).where(F.col(y) >= target)
    first = rows.agg(F.min_by(F.struct(F.col(x).alias("x"), F.col(y).alias("y"), "_x0", "_y0"), x).alias("f"))
    f = lambda c: F.col("f")[c]
    share = (target - f("_y0")) / F.nullif(f("y") - f("_y0"), F.lit(0.0))
    between = F.exp(F.log(f("_x0")) + share * (F.log(f("x")) - F.log(f("_x0"))))
    status = F.when(f("x").isNull(), "NO_CROSSING_IN_GRID").when(f("_x0").isNull(), "CROSSING_AT_OR_BELOW_GRID_MINIMUM").when(f("y") <= f("_y0"), "NONMONOTONE_LOCAL_SHARE_USED_UPPER_BRACKET").otherwise("LOG_RADIUS_INTERPOLATED")
    return first.select(F.when(status == "LOG_RADIUS_INTERPOLATED", between).otherwise(f("x")).alias("crossing"), status.alias("status"))


def review_rows(curve: DataFrame, x: str, reference: float, n: int) -> DataFrame:
    """The grid point nearest to the reference and n on either side, with their roles."""
    numbered = curve.withColumn("_k", F.row_number().over(Window.orderBy(x)))
    at = numbered.agg(F.min_by("_k", F.struct(F.abs(F.col(x) - reference), F.col(x))).alias("_c"))
    near = numbered.crossJoin(F.broadcast(at)).withColumn("offset", F.col("_k") - F.col("_c")).where(F.abs("offset") <= n)
    return near.withColumn("role", F.when(F.col("offset") == 0, "reference").when(F.col("offset") < 0, "below").otherwise("above")).drop("_k", "_c")
