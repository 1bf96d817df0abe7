"""What is counted or summed over pairs of places within a radius, without a row for each pair.

Pairs on the ground grow with the square of the units of a fixed area. So places are dealt into square
cells, a cell's own places (in parts of bounded size) meet the parts of all places that can be within the
radius of the cell, and a meeting gives counts by ball, by unit or by query, which add up."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coverscope.operators import graph
from coverscope.operators.scratch import cut

#: Rows of a part of either side, distances held at once, cells that are broadcast: at most about so many.
HOME, OTHERS, AT_ONCE, CELLS_SENT = 1024, 8192, 2**20, 100_000
WHOLE = 2**40  #: a part that holds all rows of its cell


def width(places: DataFrame, xy: Sequence[str], least: float, wanted: int = 512) -> float:
    """A width of cells: `least`, or more where cells would have fewer than about `wanted` places."""
    ends = places.agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in xy]).first()
    area = math.prod(float(ends[c] or 0) for c in xy)
    return max(least, math.sqrt(area * wanted / max(1, ends["n"]))) or 1.0


def meet(home: DataFrame, others: DataFrame, item: str, other: str, xy: Sequence[str], radius: float, cell: float, fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, sizes: tuple[int, int] = (HOME, OTHERS)) -> DataFrame:
    """fn(part of home, part of others) of all parts of a cell's own rows and of the rows that can be within radius of them; rows with a null coordinate are left out.

    Each pair of rows within radius is in just one call; a part of home without others near is called once with none."""
    cells = ["_cx", "_cy"]
    h, o = home.dropna(subset=list(xy)), others.toDF(*others.columns).dropna(subset=list(xy))  # new columns, so that a table can meet itself
    for c, at in zip(xy, cells, strict=True):
        slack = radius * (1 + 1e-6) + F.abs(c) * 1e-12
        h = h.withColumn(at, F.floor(F.col(c) / cell))
        o = o.withColumn(at, F.explode(F.sequence(F.floor((F.col(c) - slack) / cell), F.floor((F.col(c) + slack) / cell))))
    many = lambda df, size, name: df.groupBy(*cells).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    parts = cut(many(h, sizes[0], "_n").join(many(o, sizes[1], "_m"), cells, "left").fillna(1, ["_m"]))
    parts = F.broadcast(parts) if parts.count() <= CELLS_SENT else parts
    part = lambda key, n: F.pmod(F.xxhash64(key, F.lit("part")), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    h = h.join(parts, cells).withColumns({"_i": part(item, "_n"), "_j": each("_m")}).drop("_n", "_m")
    o = o.join(parts, cells).withColumns({"_j": part(other, "_m"), "_i": each("_n")}).drop("_n", "_m")
    keys = [*cells, "_i", "_j"]
    # numbers of partitions of its own: the rows that meet are few and small beside the work, so Spark would join partitions by their size
    spark = home.sparkSession
    n = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    h, o = h.repartition(n, *keys), o.repartition(n, *keys)
    return h.groupBy(*keys).cogroup(o.groupBy(*keys)).applyInPandas(fn, schema)


def distances(h: pd.DataFrame, o: pd.DataFrame, xy: Sequence[str]) -> Iterator[tuple[slice, np.ndarray]]:
    """Some rows of h at a time, and their squared distances to all of o."""
    a, b = h[list(xy)].to_numpy(float), o[list(xy)].to_numpy(float)
    for start in range(0, len(a), step := max(1, AT_ONCE // max(1, len(b)))):
        at = slice(start, min(start + step, len(a)))
        d2 = np.zeros((at.stop - at.start, len(b)))
        for i in range(len(xy)):
            d2 += (a[at, i, None] - b[None, :, i]) ** 2
        yield at, d2


def adjacent(h: pd.DataFrame, o: pd.DataFrame, radius: float) -> Iterator[tuple[slice, np.ndarray]]:
    """Some rows of h at a time, and which other units of o are within the radius."""
    u, v = h["unit"].to_numpy(), o["unit"].to_numpy()
    for at, d2 in distances(h, o, ["x", "y"]):
        yield at, (d2 <= radius * radius) & (u[at, None] != v[None, :])


def incidence(*sides: pd.DataFrame) -> tuple:
    """The balls of all sides, and a 0/1 matrix, rows by balls, of each side."""
    names = np.unique(np.concatenate([np.asarray(x, np.int64) for s in sides for x in s["_in"]] or [np.zeros(0, np.int64)]))
    out = []
    for s in sides:
        m, size = np.zeros((len(s), len(names)), np.float32), [len(x) for x in s["_in"]]
        if sum(size):
            m[np.repeat(np.arange(len(s)), size), np.searchsorted(names, np.concatenate(list(s["_in"])))] = 1
        out.append(m)
    return names, *out


def placed(membership: DataFrame, places: DataFrame) -> DataFrame:
    """unit, x, y and _in, the balls of each unit: as many as the packing of the space allows."""
    balls = membership.groupBy("unit").agg(F.collect_set(F.col("ball_id").cast("bigint")).alias("_in"))
    return places.select("unit", "x", "y").join(balls, "unit", "left").withColumn("_in", F.coalesce("_in", F.array().cast("array<bigint>")))


def membership_moran(membership: DataFrame, places: DataFrame, radius: float, sizes: tuple[int, int] = (HOME, OTHERS)) -> DataFrame:
    """profile.membership_moran of units at most radius apart, with a row for every ball. places: unit, x and y."""
    rows = cut(placed(membership, places))
    cell = width(rows, ["x", "y"], 1.5 * radius)
    kind = rows.schema["unit"].dataType.simpleString()

    def counted(h: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        found = [a.sum(axis=1) for _, a in adjacent(h, o, radius)]
        return pd.DataFrame({"unit": h["unit"], "d": np.concatenate(found) if found else np.zeros(0, int)})

    def summed(h: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        names, m, n = incidence(h, o)
        share, w, s = 1 / h["d"].to_numpy(float), np.zeros(len(names)), np.zeros(len(names))
        for at, a in adjacent(h, o, radius):
            inside = (a.astype(np.float32) @ n) * share[at, None]
            w, s = w + inside.sum(axis=0), s + (inside * m[at]).sum(axis=0)
        return pd.DataFrame({"ball_id": names, "w": w, "s": s})

    few = rows.select("unit", "x", "y")
    degree = cut(meet(few, few, "unit", "unit", ["x", "y"], radius, cell, counted, f"unit {kind}, d bigint", sizes).groupBy("unit").agg(F.sum("d").alias("d")).where("d > 0"))
    known = rows.join(degree, "unit")
    sums = meet(known, rows, "unit", "unit", ["x", "y"], radius, cell, summed, "ball_id bigint, w double, s double", sizes).groupBy("ball_id").agg(F.sum("w").alias("_w"), F.sum("s").alias("_s"))
    size = known.select(F.explode("_in").alias("ball_id")).groupBy("ball_id").agg(F.count("*").alias("k"))
    p = F.coalesce("k", F.lit(0)) / F.col("n")
    value = (F.coalesce("_s", F.lit(0.0)) - p * F.coalesce("_w", F.lit(0.0))) / F.nullif(F.col("n") * p * (1 - p), F.lit(0.0))
    every = membership.select("ball_id").distinct().join(size, "ball_id", "left").join(sums, "ball_id", "left")
    return every.crossJoin(F.broadcast(degree.agg(F.count("*").alias("n")))).where("n > 0").select("ball_id", value.alias("moran"))


def ball_adjacency(membership: DataFrame, places: DataFrame, radius: float, sizes: tuple[int, int] = (HOME, OTHERS)) -> DataFrame:
    """profile.ball_adjacency of units at most radius (above 0) apart. places: unit, x and y.

    Members of one ball in one small square, whose diagonal is below the radius, are one node; nodes are
    linked where the members of two squares are within the radius anywhere. So the graph grows with balls and squares."""
    if not radius > 0:
        raise ValueError("the radius must be above 0")
    side = radius / 1.415
    square = F.struct(*[F.floor(F.col(c) / side).alias(f"s{c}") for c in "xy"])
    rows = cut(placed(membership, places))

    def linked(h: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        def by_square(pdf: pd.DataFrame) -> tuple:
            at = np.floor(pdf[["x", "y"]].to_numpy(float) / side).astype(np.int64)
            order = np.lexsort((at[:, 1], at[:, 0]))
            pdf, at = pdf.iloc[order], at[order]
            starts = np.flatnonzero(np.concatenate([[True], (np.diff(at, axis=0) != 0).any(axis=1)])) if len(at) else np.zeros(0, int)
            return pdf, at[starts], np.append(starts, len(at))

        h, a_at, a_cuts = by_square(h)
        o, b_at, b_cuts = by_square(o)
        names, m, n = incidence(h, o)
        out = np.zeros((len(a_at), len(b_at), len(names)))
        for at, a in adjacent(h, o, radius):
            a = a.astype(np.float32)
            for j in range(len(b_at)):
                inside = (a[:, b_cuts[j] : b_cuts[j + 1]] @ n[b_cuts[j] : b_cuts[j + 1]]) * m[at]
                upto = np.concatenate([np.zeros((1, len(names))), np.cumsum(inside, axis=0, dtype=np.float64)])
                edge = np.clip(a_cuts, at.start, at.stop) - at.start
                out[:, j] += upto[edge[1:]] - upto[edge[:-1]]
        i, j, b = np.nonzero(out)
        return pd.DataFrame({"ball_id": names[b], "ax": a_at[i, 0], "ay": a_at[i, 1], "bx": b_at[j, 0], "by": b_at[j, 1], "n": out[i, j, b].astype(np.int64)})

    cell = width(rows, ["x", "y"], 2 * side)
    met = meet(rows, rows, "unit", "unit", ["x", "y"], radius, cell, linked, "ball_id bigint, ax bigint, ay bigint, bx bigint, by bigint, n bigint", sizes)
    met = cut(met.groupBy("ball_id", F.struct(F.col("ax").alias("sx"), F.col("ay").alias("sy")).alias("a"), F.struct(F.col("bx").alias("sx"), F.col("by").alias("sy")).alias("b")).agg(F.sum("n").alias("n")))
    members = rows.select(F.explode("_in").alias("ball_id"), F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), square).alias("node"))
    nodes = cut(members.where("node is not null").groupBy("ball_id", "node").agg(F.count("*").alias("_n")))
    labels = graph.components(nodes.select("ball_id", "node"), met.where("a < b").select("ball_id", "a", "b"), ["ball_id"])
    sized = labels.join(nodes, ["ball_id", "node"]).groupBy("ball_id", "component").agg(F.sum("_n").alias("_n")).select("ball_id", "_n")
    parts = sized.unionByName(members.where("node is null").select("ball_id", F.lit(1).cast("bigint").alias("_n"))).groupBy("ball_id")
    shape = parts.agg(F.sum("_n").alias("n_units"), F.count("*").alias("n_components"), (F.max("_n") / F.sum("_n")).alias("largest_share"), F.count_if(F.col("_n") == 1).alias("n_singletons"))
    links = met.groupBy("ball_id").agg((F.sum("n") / 2).cast("bigint").alias("n_edges"))
    out = shape.join(links, "ball_id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    return out.withColumn("mean_degree", 2 * F.col("n_edges") / F.col("n_units"))


def cross_adjacency(membership: DataFrame, places: DataFrame, radius: float, sizes: tuple[int, int] = (HOME, OTHERS)) -> DataFrame:
    """profile.cross_adjacency of units at most radius apart. places: unit, x and y.

    Of the pairs with one end in either ball, those with both ends in both are met twice and taken off once."""
    rows = cut(placed(membership, places))

    def crossed(h: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        names, m, n = incidence(h, o)
        total = np.zeros((len(names), len(names)))
        for at, a in adjacent(h, o, radius):
            a, own = a.astype(np.float32), m[at]
            total += 2 * (own.T.astype(float) @ (a @ n).astype(float))
            for i in range(len(names)):
                u, v = np.flatnonzero(own[:, i]), np.flatnonzero(n[:, i])
                if len(u) and len(v):
                    total[i] -= ((a[np.ix_(u, v)] @ n[v]) * own[u]).sum(axis=0, dtype=np.float64)
        i, j = np.nonzero(np.triu(total, 1))
        return pd.DataFrame({"a": names[i], "b": names[j], "n": total[i, j].astype(np.int64)})

    cell = width(rows, ["x", "y"], 1.5 * radius)
    met = meet(rows, rows, "unit", "unit", ["x", "y"], radius, cell, crossed, "a bigint, b bigint, n bigint", sizes)
    return met.groupBy("a", "b").agg((F.sum("n") / 2).cast("bigint").alias("n_cross")).where("n_cross > 0")


def exclusive_gaps(membership: DataFrame, places: DataFrame, home: int = HOME // 2, wanted: int = 512) -> DataFrame:
    """profile.exclusive_gaps, without a row for each unit and pair of balls. places: unit, x and y.

    Units in the same balls are alike, so a part of a cell looks up the nearest place of each kind of unit around it, and the nearest of b's
    own is the least over the kinds that are in b and not in a. What it finds within the radius it counts by pair and distance; a unit
    with pairs left over lists them and looks on in four times the radius, among the kinds that those pairs still need. The larger the radius, the rarer these kinds."""
    xy = ["x", "y"]
    rows = placed(membership, places).where(F.size("_in") > 0).dropna(subset=xy).withColumn("_in", F.sort_array("_in"))
    named = cut(membership.select(F.col("ball_id").cast("bigint").alias("ball_id")).distinct().withColumn("_rank", F.row_number().over(Window.orderBy("ball_id")) - 1))  # a row for each ball
    n = max(1, named.count())
    ranks = cut(rows.select("unit", *xy, F.explode("_in").alias("ball_id")).join(named, "ball_id").groupBy("unit", *xy).agg(F.sort_array(F.collect_list(F.col("_rank").cast("bigint"))).alias("_in")))
    kinds = cut(ranks.select("_in").distinct().withColumn("_kind", F.monotonically_increasing_id()))
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
    side = lambda own, other: kinds.select("_kind", "_in", F.explode("_in").alias(own)).select("_kind", own, F.explode(F.array_except(every, F.col("_in"))).alias(other)).where("a < b")
    code = (F.col("a") * n + F.col("b")).alias("code")
    sought = cut(side("b", "a").select("_kind", code))  # the pairs in which a kind is b's own
    asks = side("a", "b").select("_kind", code).join(sought.select("code").distinct(), "code").groupBy("_kind").agg(F.collect_list("code").alias("ask"))
    dealt = cut(ranks.join(kinds, "_in"))
    sites = cut(dealt.select(*xy, "_kind", "_in").distinct().withColumn("_site", F.monotonically_increasing_id()))
    look, found = dealt.join(asks, "_kind").select("unit", *xy, "ask"), None
    radius = width(dealt, xy, 0.0, wanted)
    schema = f"code bigint, d2 double, n bigint, unit {ranks.schema['unit'].dataType.simpleString()}, x double, y double, ask array<bigint>"

    def nearest_of(reach: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
        def run(h: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
            if not len(h):
                return pd.DataFrame(columns=["code", "d2", "n", "unit", *xy, "ask"])
            o = o.sort_values("_kind", ignore_index=True)
            _, first = np.unique(o["_kind"].to_numpy(), return_index=True)
            inside = np.zeros((len(first), n), bool)
            for i, own in enumerate(o["_in"].iloc[first]):
                inside[i, own] = True
            d2 = np.concatenate([np.minimum.reduceat(d, first, axis=1) for _, d in distances(h, o, xy)]) if len(o) else np.zeros((len(h), 0))
            size = [len(x) for x in h["ask"]]
            at, codes = np.repeat(np.arange(len(h)), size), np.concatenate(h["ask"].to_list()).astype(np.int64)
            order = np.argsort(codes, kind="stable")
            at, codes = at[order], codes[order]
            best = np.full(len(codes), np.inf)
            starts = np.flatnonzero(np.concatenate([[True], np.diff(codes) != 0]))
            for lo, hi in zip(starts, np.append(starts[1:], len(codes)), strict=True):
                a, b = divmod(int(codes[lo]), n)
                kind = np.flatnonzero(inside[:, b] & ~inside[:, a])
                if len(kind):
                    best[lo:hi] = d2[np.ix_(at[lo:hi], kind)].min(axis=1)
            done = best <= reach * reach
            counts = pd.DataFrame({"code": codes[done], "d2": best[done]}).value_counts(sort=False).rename("n").reset_index()
            left = pd.Series(codes[~done]).groupby(at[~done]).agg(list)
            more = h.iloc[left.index][["unit", *xy]].assign(ask=left.to_numpy())
            rest, none = [None] * len(more), [None] * len(counts)
            known = {c: pd.array([*counts[c], *rest], kind) for c, kind in (("code", "Int64"), ("d2", "Float64"), ("n", "Int64"))}
            return pd.DataFrame(known | {c: pd.Series([*none, *more[c]], dtype=object) for c in ("unit", *xy, "ask")})

        return run

    while True:
        met = cut(meet(look, sites, "unit", "_site", xy, radius, radius, nearest_of(radius), schema, (home, WHOLE)))
        part = met.where("code is not null").select("code", "d2", "n")
        found = part if found is None else found.unionByName(part)
        look = met.where("code is null").select("unit", *xy, "ask")
        if look.isEmpty():
            break
        still = sought.join(look.select(F.explode("ask").alias("code")).distinct(), "code").select("_kind").distinct()
        sites, radius = cut(sites.join(still, "_kind", "left_semi")), radius * 4
    found = cut(found.groupBy("code", "d2").agg(F.sum("n").alias("n")))
    upto = F.sum("n").over(Window.partitionBy("code").orderBy("d2"))
    placed_ = found.withColumn("_upto", upto).join(found.groupBy("code").agg(F.sum("n").alias("_size")), "code")
    at = lambda i: F.min(F.when(F.col("_upto") > i, F.sqrt("d2")))
    half = (F.col("_size") - 1) / 2
    gaps = placed_.groupBy("code").agg((F.min(F.sqrt("d2")) / 1000).alias("min_exclusive_km"), ((at(F.floor(half)) + at(F.ceil(half))) / 2000).alias("median_exclusive_km"))
    of = lambda c: named.select(F.col("ball_id").alias(c), F.col("_rank").alias(f"_{c}"))
    return gaps.withColumns({"_a": F.floor(F.col("code") / n), "_b": F.col("code") % n}).join(of("a"), "_a").join(of("b"), "_b").select("a", "b", "min_exclusive_km", "median_exclusive_km")
