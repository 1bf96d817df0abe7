"""Stability of covers over radii and orders, and of readouts on them. Tables carry the keys radius and replicate."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverscope.functions.columns import squared
from coverscope.operators import cover, graph, scale
from coverscope.operators.contract import exclude_values
from coverscope.operators.cover import order_key
from coverscope.operators.near import diameter, knn
from coverscope.operators.scale import quantiles
from coverscope.operators.scratch import cut
from coverscope.operators.stats import correlation, long
from coverscope.operators.sweep import Sweep, common_bits, element_bits

KEYS = ["radius", "replicate"]


def outcome_stats(membership: DataFrame, values: DataFrame, item: str, y: str, threshold: int = 1) -> DataFrame:
    """For each configuration: balls, least, largest and sd of the balls' means, and mean sd and range inside balls larger than a threshold."""
    joined = membership.join(values.select(F.col(item).alias("unit"), y), "unit")
    ball = joined.groupBy(*KEYS, "ball_id").agg(F.avg(y).alias("m"), F.count("*").alias("n"), F.stddev_samp(y).alias("s"), (F.max(y) - F.min(y)).alias("r"))
    big = F.col("n") > threshold
    return ball.groupBy(*KEYS).agg(F.count("*").alias("n_balls"), F.min("m").alias("min_colour"), F.max("m").alias("max_colour"), F.stddev_samp("m").alias("sd_colour"), F.avg("n").alias("mean_size"), F.avg(F.when(big, F.col("s"))).alias("within_sd"), F.avg(F.when(big, F.col("r"))).alias("within_range"))


def axis_ranges(membership: DataFrame, values: DataFrame, item: str, axes: Sequence[str], threshold: int = 1) -> DataFrame:
    """For each configuration and axis: mean, least and largest range inside balls larger than a threshold."""
    joined = membership.select(*KEYS, "ball_id", F.col("unit").alias(item)).join(long(values, [item], axes, "axis"), item)
    ball = joined.groupBy(*KEYS, "ball_id", "axis").agg((F.max("value") - F.min("value")).alias("_r"), F.count("*").alias("_n")).where(F.col("_n") > threshold)
    return ball.groupBy(*KEYS, "axis").agg(F.avg("_r").alias("mean_range"), F.min("_r").alias("min_range"), F.max("_r").alias("max_range"))


#: The numbers that describe a cover, in the order of cover_diagnostics().
METRICS = """n_balls n_edges n_components n_joined_components n_isolated largest_component_share min_size median_size mean_size max_size effective_balls effective_share
normalised_entropy largest_share mean_memberships max_memberships share_multicovered mean_degree max_degree sd_degree edge_density cycle_rank""".split()
FLAGS = ["connected", "none_isolated", "one_ball", "all_landmarks", "half", "three_quarters"]


def cover_diagnostics(counts: DataFrame, radii: Sequence[float], seed: int = 20260807, step: int = 1009) -> DataFrame:
    """A row of 33 columns for each cover. counts: as Sweep.counts() gives them.

    All covers go through each step together: sums over balls, units and edges by configuration,
    degrees from both ends of the edges, and components by label rounds over all overlap graphs at once."""
    counts = cut(counts)
    size = counts.where("kind = 'ball'").select(*KEYS, F.col("a").alias("node"), "n")
    edges = counts.where("kind = 'edge'").select(*KEYS, "a", "b")
    units = counts.where("kind = 'units'").groupBy(*KEYS).agg(F.sum("n").alias("n_units"), (F.sum(F.col("a") * F.col("n")) / F.sum("n")).alias("mean_memberships"), F.max("a").alias("max_memberships"), (F.sum(F.when(F.col("a") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("share_multicovered"))
    shape = size.groupBy(*KEYS).agg(F.count("*").alias("n_balls"), F.min("n").alias("min_size"), F.percentile("n", 0.5).alias("median_size"), F.avg("n").alias("mean_size"), F.max("n").alias("max_size"), (F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("_h"))
    degree = graph.both_ways(edges, KEYS).groupBy(*KEYS, "node").agg(F.count("*").alias("d")).groupBy(*KEYS).agg((F.sum("d") / 2).cast("bigint").alias("n_edges"), F.max("d").alias("max_degree"), F.sum(F.col("d") * F.col("d")).alias("_dd"))
    parts = graph.components(size.select(*KEYS, "node"), edges, KEYS).groupBy(*KEYS, "component").agg(F.count("*").alias("_n"))
    parts = parts.groupBy(*KEYS).agg(F.count("*").alias("n_components"), F.count_if(F.col("_n") > 1).alias("n_joined_components"), F.count_if(F.col("_n") == 1).alias("n_isolated"), F.max("_n").alias("_largest"))
    places = shape.sparkSession.createDataFrame([(i + 1, float(r)) for i, r in enumerate(radii)], "radius_index int, radius double")
    rows = shape.join(units, KEYS).join(parts, KEYS).join(degree, KEYS, "left").join(F.broadcast(places), "radius").fillna(0, ["n_edges", "max_degree", "_dd"])
    b, e, several = F.col("n_balls"), F.col("n_edges"), F.col("n_balls") > 1
    rows = rows.withColumns(
        {
            "seed": (seed + step * F.col("replicate")).cast("bigint"),
            "largest_component_share": F.col("_largest") / b,
            "connected": F.col("n_components") == 1,
            "none_isolated": F.col("n_isolated") == 0,
            "one_ball": b == 1,
            "all_landmarks": b == F.col("n_units"),
            "effective_balls": F.exp("_h"),
            "effective_share": F.exp("_h") / b,
            "normalised_entropy": F.when(several, F.col("_h") / F.log(b)).otherwise(0.0),
            "largest_share": F.col("max_size") / F.col("n_units"),
            "half": F.col("max_size") / F.col("n_units") >= 0.5,
            "three_quarters": F.col("max_size") / F.col("n_units") >= 0.75,
            "mean_degree": 2 * e / b,
            "sd_degree": F.when(several, F.sqrt(F.greatest(F.lit(0.0), (F.col("_dd") - 4 * e * e / b) / (b - 1)))).otherwise(0.0),
            "edge_density": F.when(several, 2 * e / (b * (b - 1))).otherwise(0.0),
            "cycle_rank": e - b + F.col("n_components"),
        }
    )
    return rows.select("radius_index", "radius", "replicate", "seed", "n_units", *METRICS, *FLAGS)


def summarise_by_radius(runs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """radius, metric, mean, sd, q025 and q975 over the replicates."""
    return long(runs, ["radius"], metrics, "metric").groupBy("radius", "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.percentile("value", 0.025).alias("q025"), F.percentile("value", 0.975).alias("q975"))


#: Of these metrics the summary has the tenth and ninetieth percentiles too.
SPREAD = ["n_balls", "n_edges"]


def diagnostic_summary(runs: DataFrame, stable: DataFrame | None = None) -> DataFrame:
    """A row for each radius: n_runs, the median of every metric (<metric>_median), q10, q90 and sd of some, and the rate of every flag, with the columns of stable (radius) beside them."""
    q = lambda c, p, n: F.percentile(c, p).alias(f"{c}_{n}")
    rows = runs.groupBy("radius_index", "radius").agg(
        F.count("*").alias("n_runs"),
        F.max("n_units").alias("n_units"),
        *[q(c, 0.5, "median") for c in METRICS],
        *[q(c, p, n) for c in SPREAD for p, n in ((0.1, "q10"), (0.9, "q90"))],
        F.stddev_samp("n_balls").alias("n_balls_sd"),
        *[F.avg(F.col(c).cast("double")).alias(f"{c}_rate") for c in FLAGS],
    )
    return rows if stable is None else rows.join(stable, "radius", "left")


def audit_sample(df: DataFrame, item: str, n: int, seed: int) -> DataFrame:
    """The n units that come first in a random order."""
    return df.select(item, order_key(item, seed).alias("_k")).orderBy("_k", item).limit(n).select(item)


def bit_stability(bits: DataFrame, runs: DataFrame, name: str) -> DataFrame:
    """radius, n_pairs, and mean, median, q10 and least Jaccard of the sets of all pairs of replicates; two empty sets are alike.

    bits: radius, replicate, bucket and bitmap (see sweep.py); runs: radius and replicate of all sets, empty ones too."""
    bits = cut(bits)
    size = runs.join(bits.groupBy(*KEYS).agg(F.sum(F.bitmap_count("bitmap")).alias("n")), KEYS, "left").fillna(0, ["n"])
    pairs = size.select("radius", F.col("replicate").alias("ra"), F.col("n").alias("na")).join(size.select("radius", F.col("replicate").alias("rb"), F.col("n").alias("nb")), "radius").where("ra < rb")
    both = pairs.join(common_bits(bits), ["radius", "ra", "rb"], "left").fillna(0, ["common"])
    j = F.coalesce(F.col("common") / F.nullif(F.col("na") + F.col("nb") - F.col("common"), F.lit(0)), F.lit(1.0))
    return both.select("radius", j.alias("_j")).groupBy("radius").agg(F.count("*").alias("n_pairs"), F.avg("_j").alias(f"{name}_mean"), F.percentile("_j", 0.5).alias(f"{name}_median"), F.percentile("_j", 0.1).alias(f"{name}_q10"), F.min("_j").alias(f"{name}_min"))


def sweep_stability(swept: Sweep, sample: DataFrame, item: str = "id") -> DataFrame:
    """radius, n_pairs, and the stability of the shared balls of a sample (cover_*) and of the landmarks (landmark_*)."""
    runs = swept.work.select(F.explode("radii").alias("radius"), "replicate")
    shared = bit_stability(swept.pair_bits(sample, item), runs, "cover")
    return shared.join(bit_stability(element_bits(swept.balls().select(*KEYS, "landmark"), "landmark"), runs, "landmark").drop("n_pairs"), "radius")


def comembership(membership: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, id1 < id2 of the units that share a ball; meant for a bounded sample or a few focal units."""
    a = membership.select(*keys, "ball_id", F.col("unit").alias("id1"))
    b = membership.select(*keys, "ball_id", F.col("unit").alias("id2"))
    return a.join(b, [*keys, "ball_id"]).where("id1 < id2").select(*keys, "id1", "id2").distinct()


def membership_stability(membership: DataFrame, isolated: DataFrame) -> DataFrame:
    """radius, unit, mean number of balls, mean number of isolated balls, and how often it is in isolated balls alone. isolated: keys and ball_id."""
    marked = membership.join(isolated.select(*KEYS, "ball_id", F.lit(1).alias("_i")), [*KEYS, "ball_id"], "left")
    run = marked.groupBy(*KEYS, "unit").agg(F.count("*").alias("_n"), F.count("_i").alias("_k"))
    return run.groupBy("radius", "unit").agg(F.avg("_n").alias("mean_memberships"), F.avg("_k").alias("mean_isolated"), F.avg((F.col("_n") == F.col("_k")).cast("double")).alias("isolation_frequency"))


def comembership_frequency(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """radius, id1, id2 and the share of the runs in which they share a ball."""
    n = runs.groupBy("radius").agg(F.count("*").alias("_n"))
    return pairs.groupBy("radius", "id1", "id2").agg(F.count("*").alias("runs_together")).join(F.broadcast(n), "radius").withColumn("frequency", F.col("runs_together") / F.col("_n")).drop("_n")


def colour_robustness(colours: DataFrame, canonical: DataFrame, variables: Sequence[str]) -> DataFrame:
    """variable, and for each configuration RMSE, MAE and correlation of the local colours with the canonical ones; all variables in one join."""
    a = long(colours, [*KEYS, "unit"], variables, value="_a")
    b = long(canonical, ["unit"], variables, value="_b")
    d = F.col("_a") - F.col("_b")
    return a.join(b, ["unit", "variable"]).groupBy("variable", *KEYS).agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), correlation(F.col("_a"), F.col("_b")).alias("pearson"))


def robustness_by_radius(rows: DataFrame) -> DataFrame:
    """variable, radius, n_runs, and median, q10 and q90 of RMSE, MAE and correlation over the replicates."""
    levels = {"median": 0.5, "q10": 0.1, "q90": 0.9}
    return rows.groupBy("variable", "radius").agg(F.count("*").alias("n_runs"), *[F.percentile(c, p).alias(f"{c}_{n}") for c in ("rmse", "mae", "pearson") for n, p in levels.items()])


def point_stability(colours: DataFrame, variable: str) -> DataFrame:
    return colours.groupBy("radius", "unit").agg(F.avg(variable).alias("mean"), F.stddev_samp(variable).alias("sd"), F.percentile(variable, 0.1).alias("q10"), F.percentile(variable, 0.9).alias("q90"))


def pattern_vs_reference(points: DataFrame, reference: float) -> DataFrame:
    """radius, RMSE and correlation of the mean pattern with that of the reference radius."""
    ref = points.where(F.col("radius") == reference).select("unit", F.col("mean").alias("_b"))
    d = F.col("mean") - F.col("_b")
    return points.join(ref, "unit").groupBy("radius").agg(F.sqrt(F.avg(d * d)).alias("rmse"), correlation(F.col("mean"), F.col("_b")).alias("pearson"))


def order_robustness(points: DataFrame, canonical: DataFrame, variable: str) -> DataFrame:
    """radius, mean absolute difference of canonical and mean colour, and the share of units with the canonical one inside [q10, q90]."""
    both = points.join(canonical.select("unit", F.col(variable).alias("_c")), "unit")
    return both.groupBy("radius").agg(F.avg(F.abs(F.col("_c") - F.col("mean"))).alias("mean_abs_difference"), F.avg(F.col("_c").between(F.col("q10"), F.col("q90")).cast("double")).alias("share_inside"))


NN_LEVELS = {"nn_q05": 0.05, "nn_q25": 0.25, "nn_q50": 0.5, "nn_q75": 0.75, "nn_q95": 0.95}
PAIR_LEVELS = {"pair_q01": 0.01, "pair_q05": 0.05, "pair_q10": 0.1, "pair_q25": 0.25, "pair_q50": 0.5, "pair_q75": 0.75, "pair_q90": 0.9, "pair_q95": 0.95, "pair_q99": 0.99}


def distance_diagnostics(df: DataFrame, item: str, axes: Sequence[str], sample: int = 256, seed: int = 7) -> DataFrame:
    """One row of distances; rows with a null axis are left out.

    Over all units: n_units, n_duplicates (pairs at distance 0), min_positive, max, and the least,
    quantiles and largest of the distances to the nearest unit (units that have a double left out).
    pair_q01 to pair_q99 are quantiles over the pairs of `sample` units by hash."""
    base = df.select(item, *[F.col(a).cast("double").alias(a) for a in axes]).dropna()
    places = cut(base.groupBy(*axes).agg(F.min(item).alias(item), F.count("*").alias("_n")))
    near = cut(knn(places, item, axes, 1).join(places.select(item, "_n"), item).select("distance", "_n"))
    alone = near.where("_n = 1")
    row = places.agg(F.sum("_n").alias("n_units"), (F.sum(F.col("_n") * (F.col("_n") - 1)) / 2).cast("bigint").alias("n_duplicates"))
    ends = near.agg(F.min("distance").alias("min_positive")).crossJoin(diameter(places, axes).withColumnRenamed("diameter", "max")).crossJoin(alone.agg(F.min("distance").alias("nn_min"), F.max("distance").alias("nn_max")))
    nearest = quantiles(alone, "distance", list(NN_LEVELS.values())).select(*[F.col("quantiles")[i].alias(c) for i, c in enumerate(NN_LEVELS)])
    few = cut(base.join(F.broadcast(audit_sample(base, item, sample, seed)), item))
    b = few.select(F.col(item).alias("_i"), *[F.col(x).alias(f"_{x}") for x in axes])
    d = F.sqrt(squared([F.col(x) for x in axes], [F.col(f"_{x}") for x in axes]))
    pairs = few.crossJoin(F.broadcast(b)).where(F.col(item) < F.col("_i")).agg(F.percentile(d, F.lit(list(PAIR_LEVELS.values()))).alias("q"))
    return row.crossJoin(ends).crossJoin(nearest).crossJoin(pairs.select(*[F.col("q")[i].alias(c) for i, c in enumerate(PAIR_LEVELS)]))


def geometric_grid(diagnostics: DataFrame, n: int) -> DataFrame:
    """radius_index and radius: n steps of equal ratio from 0.75 times the least positive to just above the largest distance."""
    lo, hi = 0.75 * F.col("min_positive"), (1 + 1e-9) * F.col("max")
    i = F.explode(F.sequence(F.lit(1), F.lit(n))).alias("radius_index")
    return diagnostics.select("min_positive", "max", i).select("radius_index", (lo * F.pow(hi / lo, (F.col("radius_index") - 1) / (n - 1))).alias("radius"))


def arithmetic_grid(spark, start: float, stop: float, step: float) -> DataFrame:
    """radius_index and radius; the span must be a whole number of steps."""
    n = round((stop - start) / step)
    if n < 0 or abs(start + n * step - stop) > 1e-9:
        raise ValueError("the span is no whole number of steps")
    return spark.range(1, n + 2).select(F.col("id").cast("int").alias("radius_index"), F.round(F.lit(start) + (F.col("id") - 1) * step, 9).alias("radius"))


#: Names and roles of the transitions, which readers of the report look for.
TRANSITIONS = {
    "first_nontrivial_topology": "topology_transition",
    "cover_stability_trough": "order_sensitivity_transition",
    "peak_multicover": "overlap_transition",
    "connected_rate_ge_0_50": "descriptive_only",
    "connected_rate_ge_0_95": "descriptive_only",
    "no_isolate_rate_ge_0_50": "descriptive_only",
    "no_isolate_rate_ge_0_95": "descriptive_only",
    "median_balls_le_20": "descriptive_only",
    "median_balls_le_10": "descriptive_only",
    "median_balls_le_5": "descriptive_only",
    "one_ball_rate_ge_0_50": "collapse_transition",
}
TARGETS = [0.40, 0.50, 0.60, 0.75]


def transition_report(summary: DataFrame) -> DataFrame:
    """transition, radius (null if there is none) and role. summary: as diagnostic_summary() gives it, with cover_mean.

    The trough and the peak lie between the first radius with any structure and those at which half of the
    covers are one ball; of equal values (to nine digits) the smaller radius counts."""
    first = lambda ok: F.min(F.when(ok, F.col("radius")))
    start = summary.agg(first((F.col("share_multicovered_median") > 0) | (F.col("n_edges_median") > 0) | (F.col("n_balls_median") < F.col("n_units"))).alias("_start"))
    rows = summary.crossJoin(F.broadcast(start))
    inside = (F.col("radius") >= F.col("_start")) & (F.col("one_ball_rate") < 0.5)
    best = lambda c: F.min_by("radius", F.when(inside, F.struct(F.round(c, 9), "radius")))
    found = [
        F.max("_start"),
        best(F.col("cover_mean")),
        best(-F.col("share_multicovered_median")),
        *[first(F.col(c) >= x) for c in ("connected_rate", "none_isolated_rate") for x in (0.5, 0.95)],
        *[first(F.col("n_balls_median") <= x) for x in (20, 10, 5)],
        first(F.col("one_ball_rate") >= 0.5),
    ]
    listed = F.array(*[F.struct(F.lit(k).alias("transition"), r.alias("radius"), F.lit(role).alias("role")) for (k, role), r in zip(TRANSITIONS.items(), found, strict=True)])
    return rows.agg(listed.alias("_r")).select(F.inline("_r"))


def dominance_crossings(summary: DataFrame, n_axes: int, targets: Sequence[float] = TARGETS, share: str = "largest_share_median") -> DataFrame:
    """target, radius where the share first reaches it (interpolated in the logarithm), the bracketing radii and shares, status, radius by root of the axes, role."""
    w = Window.orderBy("radius")  # a row for each radius of the grid
    rows = summary.select("radius", F.col(share).alias("share"), F.lag("radius").over(w).alias("_r"), F.lag(share).over(w).alias("_s"))
    at = [rows.where(F.col("share") >= t).agg(F.min_by(F.struct("radius", "share", "_r", "_s"), "radius").alias("x")).select(F.lit(float(t)).alias("target"), "x.*") for t in targets]
    found = reduce(DataFrame.unionByName, at)
    between = F.exp(F.log("_r") + (F.col("target") - F.col("_s")) / (F.col("share") - F.col("_s")) * (F.log("radius") - F.log("_r")))
    status = (
        F.when(F.col("radius").isNull(), "NO_CROSSING_IN_GRID")
        .when(F.col("_r").isNull(), "CROSSING_AT_OR_BELOW_GRID_MINIMUM")
        .when(F.col("share") <= F.col("_s"), "NONMONOTONE_LOCAL_SHARE_USED_UPPER_BRACKET")
        .otherwise("LOG_RADIUS_INTERPOLATED")
    )
    out = found.withColumn("status", status).withColumn("reference_radius", F.when(F.col("status") == "LOG_RADIUS_INTERPOLATED", between).otherwise(F.col("radius")))
    return out.select(
        "target",
        "reference_radius",
        F.col("_r").alias("lower_radius"),
        F.col("radius").alias("upper_radius"),
        F.col("_s").alias("lower_share"),
        F.col("share").alias("upper_share"),
        "status",
        (F.col("reference_radius") / n_axes**0.5).alias("radius_per_root_axes"),
        F.when(F.abs(F.col("target") - 0.5) < 1e-12, "PRIMARY").otherwise("SENSITIVITY").alias("role"),
    )


def resolution_reference(summary: DataFrame, crossings: DataFrame) -> DataFrame:
    """One row: the radius of the half-way crossing, the band between those of 40 and 60 % (null unless both exist), and the nearest radius of the grid (by logarithm) with its figures."""
    of = lambda t: F.max(F.when(F.abs(F.col("target") - t) < 1e-12, F.col("reference_radius")))
    row = crossings.agg(of(0.5).alias("reference_radius"), of(0.4).alias("_a"), of(0.6).alias("_b"), F.max(F.when(F.col("role") == "PRIMARY", F.col("radius_per_root_axes"))).alias("radius_per_root_axes"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    row = row.select("reference_radius", "radius_per_root_axes", F.when(both, F.least("_a", "_b")).alias("band_lower"), F.when(both, F.greatest("_a", "_b")).alias("band_upper"))
    gap = F.abs(F.log("radius") - F.log("reference_radius"))
    nearest = summary.crossJoin(F.broadcast(row.select("reference_radius"))).where("reference_radius IS NOT NULL").agg(F.min_by(F.struct("radius", "n_balls_median", "effective_balls_median", "largest_share_median", "cover_mean"), F.struct(F.round(gap, 12), "radius")).alias("x"))
    return row.crossJoin(F.broadcast(nearest)).select("reference_radius", "radius_per_root_axes", "band_lower", "band_upper", F.col("x.radius").alias("nearest_radius"), *[F.col(f"x.{c}").alias(f"nearest_{c}") for c in ("n_balls_median", "effective_balls_median", "largest_share_median", "cover_mean")])


def radius_review(reference: DataFrame, proposed: float, n_axes: int) -> DataFrame:
    """One row: a proposed radius against the reference and its band. Nothing is approved by it."""
    return reference.select(
        F.lit(float(proposed)).alias("proposed"),
        F.lit(float(proposed) / n_axes**0.5).alias("radius_per_root_axes"),
        "reference_radius",
        (F.abs(F.lit(float(proposed)) - F.col("reference_radius")) / F.col("reference_radius")).alias("relative_difference"),
        "band_lower",
        "band_upper",
        F.coalesce(F.lit(float(proposed)).between(F.col("band_lower"), F.col("band_upper")), F.lit(False)).alias("inside_band"),
        F.when(F.col("band_lower").isNull(), "NO_BAND").when(F.lit(float(proposed)) < F.col("band_lower"), "BELOW_BAND").when(F.lit(float(proposed)) > F.col("band_upper"), "ABOVE_BAND").otherwise("INSIDE_BAND").alias("position"),
        F.lit(False).alias("approved"),
    )


def review_checks(summary: DataFrame, review: DataFrame, tolerance: float = 1e-8, dominance: float = 0.75) -> DataFrame:
    """kind ('integrity' or 'flag'), name and outcome of a review at the exact radius. Integrity must hold for the evidence to be complete; flags only describe."""
    exact = summary.crossJoin(F.broadcast(review.select("proposed"))).where(F.abs(F.col("radius") - F.col("proposed")) <= tolerance).drop("proposed")
    row = review.join(F.broadcast(exact.limit(1)), F.lit(True), "left")
    bounded = lambda c: F.coalesce(F.col(c).between(0, 1), F.lit(False))
    c = F.coalesce
    integrity = {
        "exact_radius_evaluated": F.col("radius").isNotNull(),
        "exact_radius_positive": c(F.col("radius") > 0, F.lit(False)),
        "one_ball_rate_bounded": bounded("one_ball_rate"),
        "median_balls_at_least_one": c(F.col("n_balls_median") >= 1, F.lit(False)),
        "median_effective_balls_at_least_one": c(F.round("effective_balls_median", 9) >= 1, F.lit(False)),
        "largest_share_bounded": bounded("largest_share_median"),
        "cover_stability_bounded": bounded("cover_mean"),
        "band_valid": c((F.col("band_lower") > 0) & (F.col("band_upper") > F.col("band_lower")), F.lit(False)),
        "not_approved_by_itself": ~F.col("approved"),
    }
    flags = {
        "outside_band": ~F.col("inside_band"),
        "one_ball_observed": c(F.col("one_ball_rate") > 0, F.lit(False)),
        "median_balls_at_most_one": c(F.col("n_balls_median") <= 1, F.lit(False)),
        "median_effective_balls_at_most_one": c(F.round("effective_balls_median", 9) <= 1, F.lit(False)),
        "dominant_ball": c(F.col("largest_share_median") >= dominance, F.lit(False)),
        "some_covers_not_connected": c(F.col("connected_rate") < 1, F.lit(False)),
        "some_balls_isolated": c(F.col("none_isolated_rate") < 1, F.lit(False)),
    }
    listed = [F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), value.alias("outcome")) for kind, group in (("integrity", integrity), ("flag", flags)) for name, value in group.items()]
    return row.select(F.inline(F.array(*listed)))


def window_summary(runs: DataFrame, metrics: Sequence[str], low: float, high: float, nearest: float) -> DataFrame:
    """metric, mean, least and largest value in a window of radii, and the mean at the grid radius nearest to one."""
    inside = long(runs.where(F.col("radius").between(low, high)), ["radius"], metrics, "metric")
    by = inside.groupBy("metric", "radius").agg(F.avg("value").alias("m"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n"))
    return by.groupBy("metric").agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("mean"), F.min("lo").alias("min"), F.max("hi").alias("max"), F.min_by("m", F.struct(F.abs(F.col("radius") - nearest), "radius")).alias("at_nearest"))


def robustness_delta(windows: DataFrame, scenario: str, primary: str) -> DataFrame:
    """Each scenario's means less those of the primary one: difference, absolute, relative. windows: scenario, metric and mean."""
    base = windows.where(F.col(scenario) == primary).select("metric", F.col("mean").alias("_p"))
    d = F.col("mean") - F.col("_p")
    return windows.join(base, "metric").select(scenario, "metric", "mean", d.alias("difference"), F.abs(d).alias("absolute"), (d / F.nullif(F.abs(F.col("_p")), F.lit(0.0))).alias("relative"))


def family_robustness(runs: DataFrame, pattern: str) -> DataFrame:
    """family, worst and median correlation over the variables whose name starts with it. runs: variable and pearson."""
    family = F.coalesce(F.nullif(F.regexp_extract("variable", pattern, 1), F.lit("")), F.col("variable"))
    return runs.groupBy(family.alias("family")).agg(F.count("*").alias("n"), F.min("pearson").alias("worst"), F.percentile("pearson", 0.5).alias("median"))


SCALES = {"z": scale.z_score, "mad": scale.mad, "none": None}


def scenario_points(df: DataFrame, axes: dict[str, str], scenarios: dict[str, dict], item: str = "id", digits: int = 9) -> dict[str, DataFrame]:
    """The points of each scenario. axes: raw column to scaled one.

    A scenario may exclude values of a column ("exclude": (column, values), under the contract of
    exclude_values) and names its "scaling" (z, mad or none), taken over the rows that it keeps."""
    out = {}
    for name, spec in scenarios.items():
        kept = exclude_values(df, *spec["exclude"])[0] if "exclude" in spec else df
        how = SCALES[spec.get("scaling", "z")]
        scaled = how(kept, axes) if how else kept.withColumns({new: F.col(a).cast("double") for a, new in axes.items()})
        out[name] = scaled.select(item, *[F.round(c, digits).alias(c) for c in axes.values()])
    return out


def scenario_audit(df: DataFrame, points: dict[str, DataFrame], scenarios: dict[str, dict]) -> DataFrame:
    """scenario, scaling, n_before, n_removed and n_after of each scenario's points."""
    before = df.agg(F.count("*").alias("n_before"))
    rows = [before.crossJoin(p.agg(F.count("*").alias("n_after"))).select(F.lit(name).alias("scenario"), F.lit(scenarios[name].get("scaling", "z")).alias("scaling"), "n_before", (F.col("n_before") - F.col("n_after")).alias("n_removed"), "n_after") for name, p in points.items()]
    return reduce(DataFrame.unionByName, rows)


def scenario_sweep(points: dict[str, DataFrame], axes: Sequence[str], radii: Sequence[float], replicates: Sequence[int], item: str = "id") -> DataFrame:
    """scenario, radius, replicate, n_units, n_balls and largest_share of the covers of each scenario's points. Scenarios are few; each builds its covers once."""
    out = []
    for name, p in points.items():
        p = cut(p)
        size = Sweep(p, axes, radii, replicates, item).sizes().groupBy(*KEYS).agg(F.count("*").alias("n_balls"), F.max("n").alias("_max"))
        n = p.agg(F.count("*").alias("n_units"))
        out.append(size.crossJoin(F.broadcast(n)).select(F.lit(name).alias("scenario"), *KEYS, "n_units", "n_balls", (F.col("_max") / F.col("n_units")).alias("largest_share")))
    return reduce(DataFrame.unionByName, out)


def run_matrix(datasets: dict[str, DataFrame], specs: Sequence[dict], item: str = "id", tiers: Sequence | None = None) -> DataFrame:
    """run_id and the outcome statistics of each cover of the runs of some tiers (all, if none are named).

    A spec has run_id, dataset, axes, colour, radius_min, radius_max, radius_step, repetitions and
    tier. Specs of one data set and the same axes, radii and repetitions share their covers."""
    chosen = [s for s in specs if tiers is None or s["tier"] in tiers]
    if not chosen:
        raise ValueError("no run is selected")
    covers, out = {}, None
    for s in chosen:
        points, n = datasets[s["dataset"]], round((s["radius_max"] - s["radius_min"]) / s["radius_step"])
        if n < 0 or abs(s["radius_min"] + n * s["radius_step"] - s["radius_max"]) > 1e-9:
            raise ValueError(f"the span of {s['run_id']} is no whole number of steps")
        key = (s["dataset"], *s["axes"], s["radius_min"], s["radius_step"], n, s["repetitions"])
        if key not in covers:
            radii = [round(s["radius_min"] + i * s["radius_step"], 9) for i in range(n + 1)]
            covers[key] = cover.cover_grid(points, s["axes"], radii, range(1, s["repetitions"] + 1), item)[1]
        rows = outcome_stats(covers[key], points, item, s["colour"]).select(F.lit(s["run_id"]).alias("run_id"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def cross_radius_range(runs: DataFrame, metric: str) -> DataFrame:
    """replicate, least and largest value over the radii, and whether all are above 0."""
    return runs.groupBy("replicate").agg(F.min(metric).alias("low"), F.max(metric).alias("high"), F.every(F.col(metric) > 0).alias("all_nonzero"))


def pair_sample(units: DataFrame, n_pairs: int, seed: int) -> DataFrame:
    """pair, i and j: row numbers (0-based, i <> j) by hash; equal draws are moved on by one."""
    n = units.agg(F.count("*").alias("_n"))
    draw = lambda s: F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.col("pair").cast("string"), F.lit(f"{s}{seed}"))), 1, 12), 16, 10).cast("bigint"), F.col("_n"))
    pairs = units.sparkSession.range(n_pairs).withColumnRenamed("id", "pair").crossJoin(F.broadcast(n)).select("pair", "_n", draw("a").alias("i"), draw("b").alias("j"))
    moved: Column = F.when(F.col("i") == F.col("j"), F.pmod(F.col("j") + 1, F.col("_n"))).otherwise(F.col("j"))
    return pairs.select("pair", "i", moved.alias("j")).where("i <> j")


def with_positions(df: DataFrame, item: str) -> DataFrame:
    from coverscope.operators.bins import canonical_order

    return canonical_order(df, item, "position").withColumn("position", F.col("position") - 1)


def shared_balls(pairs: DataFrame, membership: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with the number of balls that both units are in."""
    lists = membership.groupBy("unit").agg(F.collect_list("ball_id").alias("balls"))
    left = lists.select(F.col("unit").alias(a), F.col("balls").alias("_x"))
    right = lists.select(F.col("unit").alias(b), F.col("balls").alias("_y"))
    return pairs.join(left, a).join(right, b).withColumn("shared", F.size(F.array_intersect("_x", "_y"))).drop("_x", "_y")

