"""Ball profiles, category mixes, overlap tables and summaries of a cover."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coverscope.functions.columns import fill_category, squared
from coverscope.operators import cover, graph
from coverscope.operators.joins import pairs
from coverscope.operators.scale import group_quantiles
from coverscope.operators.scratch import cut
from coverscope.operators.stats import long


def resolution_metrics(balls: DataFrame, n: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Effective number of balls exp(H), its share of the balls, normalised entropy, largest share of units and its flags. balls: keys and ball_size; n: one row with n units."""
    s = F.col("ball_size")
    out = balls.groupBy(*keys).agg((F.log(F.sum(s)) - F.sum(s * F.log(s)) / F.sum(s)).alias("_h"), F.count("*").alias("n_balls"), F.max(s).alias("_max")).crossJoin(F.broadcast(n))
    share = F.col("_max") / F.col("n")
    return out.select(
        *keys,
        "n_balls",
        F.exp("_h").alias("effective_balls"),
        (F.exp("_h") / F.col("n_balls")).alias("effective_share"),
        F.when(F.col("n_balls") > 1, F.col("_h") / F.log("n_balls")).otherwise(0.0).alias("normalised_entropy"),
        share.alias("largest_share"),
        (share >= 0.5).alias("half"),
        (share >= 0.75).alias("three_quarters"),
    )


def overlap_units(membership: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return membership.groupBy(*keys, "unit").agg(F.count("*").alias("n_balls"), F.array_join(F.array_sort(F.collect_list("ball_id")), ",").alias("balls")).withColumn("multicovered", F.col("n_balls") > 1)


def overlap_frequency(membership: DataFrame) -> DataFrame:
    counts = membership.groupBy("unit").agg(F.count("*").alias("n_balls")).groupBy("n_balls").agg(F.count("*").alias("n_units"))
    total = counts.agg(F.sum("n_units").alias("_t"))
    return counts.crossJoin(F.broadcast(total)).select("n_balls", "n_units", (F.col("n_units") / F.col("_t")).alias("share"))


def component_table(balls: DataFrame, membership: DataFrame, edges: DataFrame) -> DataFrame:
    """component, n_balls, n_units, isolated and the ids of its balls."""
    labels = graph.components(balls.select(F.col("ball_id").alias("node")), edges)
    own = membership.join(labels.withColumnRenamed("node", "ball_id"), "ball_id")
    ids = labels.groupBy("component").agg(F.count("*").alias("n_balls"), F.array_join(F.array_sort(F.collect_list("node")), ",").alias("balls"))
    return own.groupBy("component").agg(F.count_distinct("unit").alias("n_units")).join(ids, "component").select("component", "n_balls", "n_units", (F.col("n_balls") == 1).alias("isolated"), "balls")


def topology_summary(balls: DataFrame, membership: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A row for each configuration: balls, edges, components, isolated balls, size statistics, effective balls, memberships, share of units in several balls."""
    keys = list(keys)
    size = cover.sizes(membership, keys)
    per_unit = membership.groupBy(*keys, "unit").agg(F.count("*").alias("_k"))
    units = per_unit.groupBy(*keys).agg(F.count("*").alias("n_units"), F.avg((F.col("_k") > 1).cast("double")).alias("share_multicovered"), F.sum("_k").alias("n_memberships"))
    shape = size.groupBy(*keys).agg(F.count("*").alias("n_balls"), F.min("ball_size").alias("min_size"), F.percentile("ball_size", 0.5).alias("median_size"), F.avg("ball_size").alias("mean_size"), F.max("ball_size").alias("max_size"))
    labels = graph.components(balls.select(*keys, F.col("ball_id").alias("node")), edges, keys)
    comps = labels.groupBy(*keys, "component").agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.count("*").alias("n_components"), F.count_if(F.col("_n") == 1).alias("n_isolated"), F.max("_n").alias("largest_component"))
    links = edges.groupBy(*keys).agg(F.count("*").alias("n_edges"))
    n = F.col("ball_size")
    effective = size.groupBy(*keys).agg(F.exp(F.log(F.sum(n)) - F.sum(n * F.log(n)) / F.sum(n)).alias("effective_balls"))
    if keys:
        out = shape.join(units, keys).join(comps, keys).join(effective, keys).join(links, keys, "left")
    else:
        out = shape.crossJoin(units).crossJoin(comps).crossJoin(effective).crossJoin(links)
    return out.withColumns({"n_edges": F.coalesce("n_edges", F.lit(0)), "largest_share": F.col("max_size") / F.col("n_units")})


def ball_profile_long(membership: DataFrame, values: DataFrame, item: str, columns: Sequence[str]) -> DataFrame:
    """ball_id, variable, n, n_nonmissing, n_missing, mean, sd (0 for one member), min, max, population mean and sd, and the standardised difference."""
    rows = long(values, [item], columns)
    population = rows.groupBy("variable").agg(F.avg("value").alias("population_mean"), F.stddev_samp("value").alias("population_sd"))
    joined = membership.select("ball_id", F.col("unit").alias(item)).join(rows, item)
    out = joined.groupBy("ball_id", "variable").agg(
        F.count("*").alias("n"), F.count("value").alias("n_nonmissing"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    out = out.join(F.broadcast(population), "variable").withColumn("n_missing", F.col("n") - F.col("n_nonmissing"))
    return out.withColumn("standardised_difference", (F.col("mean") - F.col("population_mean")) / F.nullif(F.col("population_sd"), F.lit(0.0)))


def category_mix(membership: DataFrame, df: DataFrame, item: str, column: str) -> DataFrame:
    """ball_id, level, n and share, zero levels included; missing values are the level UNRESOLVED."""
    values = df.select(F.col(item).alias("unit"), fill_category(F.col(column).cast("string")).alias("level"))
    counts = membership.select("ball_id", "unit").join(values, "unit").groupBy("ball_id", "level").agg(F.count("*").alias("n"))
    full = membership.select("ball_id").distinct().crossJoin(values.select("level").distinct())
    return full.join(counts, ["ball_id", "level"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("ball_id")))


def mix_summary(mix: DataFrame) -> DataFrame:
    """ball_id, modal_level (first by name of equals), modal_share and normalised entropy over the levels present."""
    per = mix.where("n > 0").groupBy("ball_id").agg(F.min_by(F.struct("level", "share"), F.struct(-F.col("n"), "level")).alias("_m"), F.sum(-F.col("share") * F.log("share")).alias("_h"), F.count("*").alias("n_levels"))
    return per.select("ball_id", F.col("_m.level").alias("modal_level"), F.col("_m.share").alias("modal_share"), "n_levels", F.when(F.col("n_levels") > 1, F.col("_h") / F.log("n_levels")).otherwise(0.0).alias("entropy"))


def local_category_probs(membership: DataFrame, mix: DataFrame) -> DataFrame:
    """Of each unit and level: the mean, over its balls, of the balls' shares."""
    return membership.select("unit", "ball_id").join(mix, "ball_id").groupBy("unit", "level").agg(F.avg("share").alias("probability"))


def representative(membership: DataFrame, df: DataFrame, item: str, axes: Sequence[str]) -> DataFrame:
    """The member nearest to its ball's centroid, the smallest id of equals."""
    rows = membership.select("ball_id", F.col("unit").alias(item)).join(df.select(item, *axes), item)
    centre = rows.groupBy("ball_id").agg(*[F.avg(a).alias(f"_m{a}") for a in axes])
    d = F.round(squared([F.col(a) for a in axes], [F.col(f"_m{a}") for a in axes]), 9)
    return rows.join(centre, "ball_id").groupBy("ball_id").agg(F.min_by(item, F.struct(d, item)).alias("medoid"))


def membership_context(membership: DataFrame) -> DataFrame:
    """Of each ball: mean and median number of balls of its members, and the share of members in several."""
    per_unit = membership.groupBy("unit").agg(F.count("*").alias("_k"))
    return membership.join(per_unit, "unit").groupBy("ball_id").agg(F.avg("_k").alias("mean_multiplicity"), F.percentile("_k", 0.5).alias("median_multiplicity"), F.avg((F.col("_k") > 1).cast("double")).alias("share_multicovered"))


def profile_wide(balls: DataFrame, membership: DataFrame, edges: DataFrame, values: DataFrame, item: str, columns: Sequence[str], category: str) -> DataFrame:
    """One row for each ball: landmark, size, component, degree, isolated, means and standardised differences, modal category and entropy."""
    nodes = balls.select(F.col("ball_id").alias("node"))
    comp = graph.components(nodes, edges).withColumnRenamed("node", "ball_id")
    degree = graph.context(nodes, edges).select(F.col("node").alias("ball_id"), "degree")
    wide = ball_profile_long(membership, values, item, columns).groupBy("ball_id").pivot("variable", list(columns)).agg(F.first("mean").alias("mean"), F.first("standardised_difference").alias("z"))
    modes = mix_summary(category_mix(membership, values, item, category)).select("ball_id", "modal_level", "entropy")
    return balls.select("ball_id", "landmark").join(cover.sizes(membership), "ball_id").join(comp, "ball_id").join(degree, "ball_id").join(wide, "ball_id").join(modes, "ball_id").withColumn("isolated", F.col("degree") == 0)


def profile_matrix(profile: DataFrame, variables: Sequence[str]) -> DataFrame:
    """ball by variable: the standardised differences of all balls, a column for each of the given variables."""
    return profile.groupBy("ball_id").pivot("variable", list(variables)).agg(F.first("standardised_difference"))


def ball_spread(membership: DataFrame, places: DataFrame) -> DataFrame:
    """Of each ball: median, 90 % and largest distance (km) of its members to their centroid. places: unit, x and y in metres."""
    rows = membership.select("ball_id", "unit").join(places, "unit")
    centre = rows.groupBy("ball_id").agg(F.avg("x").alias("_x"), F.avg("y").alias("_y"))
    km = F.sqrt(squared([F.col("x"), F.col("y")], [F.col("_x"), F.col("_y")])) / 1000
    return rows.join(centre, "ball_id").groupBy("ball_id").agg(F.percentile(km, 0.5).alias("median_km"), F.percentile(km, 0.9).alias("q90_km"), F.max(km).alias("max_km"))


def pair_spread(membership: DataFrame, places: DataFrame) -> DataFrame:
    """Of each pair of balls: shared members, their Jaccard index, and the distance (km) of the centroids."""
    ball = membership.select("ball_id", "unit").join(places, "unit").groupBy("ball_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))
    p = pairs(ball, "ball_id").withColumnsRenamed({"ball_id_a": "a", "ball_id_b": "b"}).join(cover.edges(membership), ["a", "b"], "left")
    shared = F.coalesce("strength", F.lit(0))
    return p.select("a", "b", shared.alias("shared_members"), (shared / (F.col("n_a") + F.col("n_b") - shared)).alias("jaccard"), (F.sqrt(squared([F.col("x_a"), F.col("y_a")], [F.col("x_b"), F.col("y_b")])) / 1000).alias("centroid_km"))


def ball_adjacency(membership: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Of each ball: edges between its members, mean degree, components they form, share of the largest, and single units. adjacency: a, b once each."""
    own = membership.select("ball_id", F.col("unit").alias("a"))
    inside = adjacency.select("a", "b").join(own, "a").join(own.withColumnRenamed("a", "b"), ["ball_id", "b"]).select("ball_id", "a", "b")
    labels = graph.components(membership.select("ball_id", F.col("unit").alias("node")), inside, ["ball_id"])
    parts = labels.groupBy("ball_id", "component").agg(F.count("*").alias("_n")).groupBy("ball_id")
    shape = parts.agg(F.sum("_n").alias("n_units"), F.count("*").alias("n_components"), (F.max("_n") / F.sum("_n")).alias("largest_share"), F.count_if(F.col("_n") == 1).alias("n_singletons"))
    out = shape.join(inside.groupBy("ball_id").agg(F.count("*").alias("n_edges")), "ball_id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    return out.withColumn("mean_degree", 2 * F.col("n_edges") / F.col("n_units"))


def cross_adjacency(membership: DataFrame, adjacency: DataFrame) -> DataFrame:
    """a < b of balls, and the number of adjacent pairs of units with one end in either ball, each pair once; shared members count in both. adjacency: a, b once each."""
    pair = adjacency.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct()
    m = membership.select("unit", "ball_id")
    met = pair.join(m.withColumnsRenamed({"unit": "u", "ball_id": "_x"}), "u").join(m.withColumnsRenamed({"unit": "v", "ball_id": "_y"}), "v").where("_x <> _y")
    return met.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), "u", "v").distinct().groupBy("a", "b").agg(F.count("*").alias("n_cross"))


def membership_moran(membership: DataFrame, adjacency: DataFrame) -> DataFrame:
    """ball_id and Moran's I of being in the ball, with row-standardised weights over all units that have neighbours; null if all or none of them are in it.

    Only sums are needed: over the members, of the reciprocal degrees of their neighbours, and of those neighbours that are members too."""
    both = graph.both_ways(adjacency.select("a", "b"))
    degree = both.groupBy("node").agg(F.count("*").alias("d"))
    n = degree.agg(F.count("*").alias("n"))
    weight = both.join(degree.withColumnsRenamed({"node": "other", "d": "_d"}), "other").groupBy("node").agg(F.sum(1 / F.col("_d")).alias("w"))
    m = membership.select("ball_id", F.col("unit").alias("node"))
    size = m.join(weight, "node").groupBy("ball_id").agg(F.count("*").alias("k"), F.sum("w").alias("_w"))
    inside = m.join(both.join(degree, "node"), "node").join(m.select("ball_id", F.col("node").alias("other")), ["ball_id", "other"]).groupBy("ball_id").agg(F.sum(1 / F.col("d")).alias("_s"))
    p = F.col("k") / F.col("n")
    value = (F.coalesce("_s", F.lit(0.0)) - p * F.col("_w")) / F.nullif(F.col("n") * p * (1 - p), F.lit(0.0))
    return size.join(inside, "ball_id", "left").crossJoin(F.broadcast(n)).select("ball_id", value.alias("moran"))


def exclusive_gaps(membership: DataFrame, places: DataFrame) -> DataFrame:
    """a < b of balls with members of their own, and the least and median distance (km) from a's own members to the nearest of b's own. places: unit, x and y in metres.

    The nearest distances of all pairs are looked up together, keyed by (pair, unit): members of b lie in
    grid cells about as wide as b is sparse, each width twice the last, and who finds none looks on in the next."""
    at = cut(membership.select("ball_id", "unit").join(places.select("unit", "x", "y"), "unit"))
    size = at.groupBy("ball_id").agg(F.count("*").alias("_n"), *[f(c).alias(f"_{name}{c}") for c in "xy" for name, f in (("lo", F.min), ("hi", F.max))])
    wide = at.agg(*[(F.max(c) - F.min(c)).alias(c) for c in "xy"]).first()
    end = 2 * (float(wide["x"] or 0) + float(wide["y"] or 0)) + 1.0
    area = F.greatest(F.col("_hix") - F.col("_lox"), F.lit(1.0)) * F.greatest(F.col("_hiy") - F.col("_loy"), F.lit(1.0))
    target = size.select(F.col("ball_id").alias("b"), (2 * F.sqrt(area / F.col("_n"))).alias("_cell"))
    balls = cut(at.groupBy("unit").agg(F.collect_list("ball_id").alias("_in")))  # as many as the packing of the space allows
    others = at.withColumnRenamed("ball_id", "b").join(balls, "unit").select("b", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("_in").alias("_out"))
    strength = cover.edges(membership)
    sizes = size.select("ball_id", "_n")
    pair = pairs(sizes, "ball_id").withColumnsRenamed({"ball_id_a": "a", "ball_id_b": "b"}).join(strength, ["a", "b"], "left").withColumn("_s", F.coalesce("strength", F.lit(0)))
    pair = pair.where((F.col("_n_a") > F.col("_s")) & (F.col("_n_b") > F.col("_s"))).select("a", "b")
    asked = pair.join(at.withColumnRenamed("ball_id", "a"), "a").join(balls, "unit").where(~F.array_contains("_in", F.col("b"))).join(target, "b").select("a", "b", "unit", "x", "y", "_cell")
    wanted, done, wider = cut(asked), None, 1.0
    while True:
        cell = lambda c: F.floor(F.col(c) / (F.col("_cell") * wider))  # noqa: B023, E731
        home = others.join(target, "b").withColumns({"_cx": cell("_x"), "_cy": cell("_y")}).drop("_cell")
        look = wanted.withColumns({"_cx": F.explode(F.sequence(cell("x") - 1, cell("x") + 1))}).withColumn("_cy", F.explode(F.sequence(cell("y") - 1, cell("y") + 1)))
        d = F.sqrt(squared([F.col("x"), F.col("y")], [F.col("_x"), F.col("_y")]))
        met = look.join(home, ["b", "_cx", "_cy"]).where(~F.array_contains("_out", F.col("a")) & (d <= F.col("_cell") * wider))
        found = cut(met.groupBy("a", "b", "unit").agg(F.min(d).alias("d")))
        done = found if done is None else done.unionByName(found)
        wanted = cut(wanted.join(found.select("a", "b", "unit"), ["a", "b", "unit"], "left_anti"))
        left = wanted.agg(F.count("*"), F.min("_cell")).first()
        if not left[0] or left[1] * wider > end:
            break
        wider *= 2
    km = done.select("a", "b", (F.col("d") / 1000).alias("km"))
    return km.groupBy("a", "b").agg(F.min("km").alias("min_exclusive_km")).join(group_quantiles(km, ["a", "b"], "km", [0.5], "_q").select("a", "b", F.get("_q", F.lit(0)).alias("median_exclusive_km")), ["a", "b"])
