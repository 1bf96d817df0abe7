"""Queries on many covers, contrasts and distances on the ground."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from coverscope.functions.columns import squared
from coverscope.operators import bins, contrast, cover, ground, profile, scale, scratch, stability, stats, sweep
from coverscope.plans.covers import COVER, canonical
from coverscope.plans.frames import AXES, POINTS, UNITS, points, units, xy, x_of, y_of
from coverscope.plans.registry import Registry
from coverscope.plans.statistics import rounded

R = Registry()
RADII, REPLICATES = [1.4, 1.5, 1.6], [1, 2, 3]
#: The grid of the diagnostics: from hundreds of balls to a single one.
WIDE, ORDERS = [0.75, 1.0, 1.25, 1.5, 1.75, 2.0, 2.5, 3.0, 4.0, 6.0], [1, 2, 3, 4, 5]

GRID = (
    POINTS
    + """,
cfg AS (SELECT radius::DOUBLE AS radius, replicate FROM (VALUES (1.4), (1.5), (1.6)) r(radius), (VALUES (1), (2), (3)) k(replicate)),
opts AS (SELECT replicate, id, z1, z2, z3, row_number() OVER (PARTITION BY replicate ORDER BY md5(id || ':' || (20260807 + 1009 * replicate)), id) AS o FROM points, (VALUES (1), (2), (3)) k(replicate)),
garr AS (SELECT replicate, list(z1 ORDER BY o) AS x, list(z2 ORDER BY o) AS y, list(z3 ORDER BY o) AS z, list(id ORDER BY o) AS ids FROM opts GROUP BY replicate),
gstep AS (SELECT radius, replicate, 0::BIGINT AS ball_id, 0::BIGINT AS lm, list_transform(x, lambda v: false) AS cov FROM cfg JOIN garr USING (replicate)
  UNION ALL
  SELECT radius, replicate, ball_id + 1, pos, list_transform(range(1, len(cov) + 1), lambda i: cov[i] OR (x[i]-x[pos])*(x[i]-x[pos]) + (y[i]-y[pos])*(y[i]-y[pos]) + (z[i]-z[pos])*(z[i]-z[pos]) <= radius*radius)
  FROM (SELECT radius, replicate, ball_id, cov, list_position(cov, false)::BIGINT AS pos FROM gstep) s JOIN garr USING (replicate) WHERE coalesce(pos, 0) > 0),
gballs AS (SELECT radius, replicate, ball_id, ids[lm] AS landmark FROM gstep JOIN garr USING (replicate) WHERE lm > 0),
gm AS (SELECT b.radius, b.replicate, b.ball_id, p.id AS unit FROM gballs b JOIN points l ON l.id = b.landmark JOIN points p ON (l.z1-p.z1)*(l.z1-p.z1) + (l.z2-p.z2)*(l.z2-p.z2) + (l.z3-p.z3)*(l.z3-p.z3) <= b.radius*b.radius),
gsize AS (SELECT radius, replicate, ball_id, count(*) AS n FROM gm GROUP BY ALL),
runs AS (SELECT radius, replicate, count(*) AS n_balls, max(n) / (SELECT count(*) FROM points) AS largest_share, avg(n) AS mean_size FROM gsize GROUP BY ALL),
gbm AS (SELECT radius, replicate, ball_id, avg(a1) AS a1, avg(z1) AS z1, avg(z2) AS z2, avg(z3) AS z3 FROM gm JOIN points ON unit = id GROUP BY ALL),
glocal AS (SELECT radius, replicate, unit, avg(a1) AS a1 FROM gm JOIN gbm USING (radius, replicate, ball_id) GROUP BY ALL)"""
)
G = f"WITH RECURSIVE {GRID} "


def grid(spark, d):
    """(points, balls, membership) of the covers of all radii and replicates."""
    p = points(spark, d).persist()
    return p, *cover.cover_grid(p, AXES, RADII, REPLICATES)


def runs(p, m):
    n = p.agg(F.count("*").alias("n"))
    size = m.groupBy("radius", "replicate", "ball_id").agg(F.count("*").alias("s"))
    return size.groupBy("radius", "replicate").agg(F.count("*").alias("n_balls"), F.max("s").alias("_max"), F.avg("s").alias("mean_size")).crossJoin(F.broadcast(n)).select("radius", "replicate", "n_balls", (F.col("_max") / F.col("n")).alias("largest_share"), "mean_size")


def values(xs) -> str:
    return "(VALUES " + ", ".join(f"({x})" for x in xs) + ")"


WIDE_GRID = GRID.replace("(VALUES (1.4), (1.5), (1.6))", values(WIDE)).replace("(VALUES (1), (2), (3))", values(ORDERS))
DIAGNOSTICS = f"""{WIDE_GRID}, lk AS (SELECT DISTINCT a.radius, a.replicate, a.ball_id AS a, b.ball_id AS b FROM gm a JOIN gm b ON a.radius = b.radius AND a.replicate = b.replicate AND a.unit = b.unit AND a.ball_id < b.ball_id),
lw AS (SELECT radius, replicate, a AS node, b AS other FROM lk UNION ALL SELECT radius, replicate, b, a FROM lk),
rch AS (SELECT radius, replicate, ball_id AS node, ball_id AS other FROM gballs UNION SELECT r.radius, r.replicate, r.node, e.other FROM rch r JOIN lw e ON r.radius = e.radius AND r.replicate = e.replicate AND r.other = e.node),
lb AS (SELECT radius, replicate, node, min(other) AS c FROM rch GROUP BY ALL), cs AS (SELECT radius, replicate, c, count(*) AS n FROM lb GROUP BY ALL),
cc AS (SELECT radius, replicate, count(*) AS n_components, count(*) FILTER (n > 1) AS n_joined_components, count(*) FILTER (n = 1) AS n_isolated, max(n) AS largest FROM cs GROUP BY ALL),
dg AS (SELECT b.radius, b.replicate, b.ball_id, count(other) AS d FROM gballs b LEFT JOIN lw ON lw.radius = b.radius AND lw.replicate = b.replicate AND node = ball_id GROUP BY ALL),
dd AS (SELECT radius, replicate, (sum(d) / 2)::BIGINT AS n_edges, avg(d) AS mean_degree, max(d) AS max_degree, coalesce(stddev_samp(d), 0) AS sd_degree FROM dg GROUP BY ALL),
mu AS (SELECT radius, replicate, count(*) AS n_units, avg(k) AS mean_memberships, max(k) AS max_memberships, avg((k > 1)::INT) AS share_multicovered FROM (SELECT radius, replicate, unit, count(*) AS k FROM gm GROUP BY ALL) GROUP BY ALL),
ps AS (SELECT *, n / sum(n) OVER (PARTITION BY radius, replicate) AS p FROM gsize),
sz AS (SELECT radius, replicate, count(*) AS n_balls, min(n) AS min_size, median(n) AS median_size, avg(n) AS mean_size, max(n) AS max_size, -sum(p * ln(p)) AS h FROM ps GROUP BY ALL),
dx AS (SELECT list_position([{', '.join(map(str, WIDE))}], radius)::INT AS radius_index, radius, replicate, 20260807 + 1009 * replicate AS seed, n_units, n_balls, n_edges, n_components, n_joined_components, n_isolated, largest / n_balls AS largest_component_share,
  n_components = 1 AS connected, n_isolated = 0 AS none_isolated, n_balls = 1 AS one_ball, n_balls = n_units AS all_landmarks, min_size, median_size, mean_size, max_size, exp(h) AS effective_balls, exp(h) / n_balls AS effective_share,
  CASE WHEN n_balls > 1 THEN h / ln(n_balls) ELSE 0 END AS normalised_entropy, max_size / n_units AS largest_share, max_size / n_units >= 0.5 AS half, max_size / n_units >= 0.75 AS three_quarters, mean_memberships, max_memberships, share_multicovered,
  mean_degree, max_degree, sd_degree, CASE WHEN n_balls > 1 THEN n_edges / (n_balls * (n_balls - 1) / 2) ELSE 0 END AS edge_density, n_edges - n_balls + n_components AS cycle_rank FROM sz JOIN cc USING (radius, replicate) JOIN dd USING (radius, replicate) JOIN mu USING (radius, replicate))"""
DX = f"WITH RECURSIVE {DIAGNOSTICS} "
EXACT = ["largest_component_share", "mean_size", "effective_balls", "effective_share", "normalised_entropy", "largest_share", "mean_memberships", "share_multicovered", "mean_degree", "sd_degree", "edge_density"]


def wide(spark, d):
    """(points, the sweep of the wide grid)."""
    p = points(spark, d).persist()
    return p, sweep.Sweep(p, AXES, WIDE, ORDERS)


def diagnostics(spark, d):
    return stability.cover_diagnostics(wide(spark, d)[1].counts(), WIDE)


@R.add("i23_cover_grid", DX + f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in EXACT)}) FROM dx")
def i23(spark, d):
    return rounded(diagnostics(spark, d), *EXACT)


NARROW = DIAGNOSTICS.replace(WIDE_GRID, GRID).replace(", ".join(map(str, WIDE)), ", ".join(map(str, RADII)))
GRAPH = ["n_edges", "n_components", "n_isolated", "mean_degree", "sd_degree", "connected"]


@R.add("i24_outcome_stats", f"WITH RECURSIVE {NARROW}, bb AS (SELECT radius, replicate, ball_id, avg(a2) AS m, count(*) AS n, stddev_samp(a2) AS s, max(a2) - min(a2) AS r FROM gm JOIN points ON unit = id GROUP BY ALL), ou AS (SELECT radius, replicate, count(*) AS n_balls, round(min(m), 6) AS min_colour, round(max(m), 6) AS max_colour, round(stddev_samp(m), 6) AS sd_colour, round(avg(n), 6) AS mean_size, round(avg(s) FILTER (n > 1), 6) AS within_sd, round(avg(r) FILTER (n > 1), 6) AS within_range, round(max(m) - min(m), 6) AS colour_range FROM bb GROUP BY ALL) SELECT ou.*, n_edges, n_components, n_isolated, round(mean_degree, 6) AS mean_degree, round(sd_degree, 6) AS sd_degree, connected FROM ou JOIN dx USING (radius, replicate)")
def _(spark, d):
    p = points(spark, d).persist()
    s = sweep.Sweep(p, AXES, RADII, REPLICATES)
    rows = stability.outcome_stats(scratch.cut(s.members()), p, "id", "a2").withColumn("colour_range", F.col("max_colour") - F.col("min_colour"))
    graphs = stability.cover_diagnostics(s.counts(), RADII).select("radius", "replicate", *GRAPH)
    return rounded(rows.join(graphs, ["radius", "replicate"]), "min_colour", "max_colour", "sd_colour", "mean_size", "within_sd", "within_range", "colour_range", "mean_degree", "sd_degree")


@R.add("i25_axis_ranges", G + ", l AS (SELECT id, unnest(['z1', 'z2', 'z3']) AS axis, unnest([z1, z2, z3]) AS v FROM points), b AS (SELECT radius, replicate, ball_id, axis, max(v) - min(v) AS r, count(*) AS n FROM gm JOIN l ON unit = id GROUP BY ALL) SELECT radius, replicate, axis, round(avg(r), 6) AS mean_range, round(min(r), 6) AS min_range, round(max(r), 6) AS max_range FROM b WHERE n > 1 GROUP BY ALL")
def _(spark, d):
    p, _, m = grid(spark, d)
    return rounded(stability.axis_ranges(m, p, "id", AXES), "mean_range", "min_range", "max_range")


METRIC_LIST = ", ".join(f"'{c}'" for c in stability.METRICS)


@R.add("i26_summarise_by_radius", DX + f", l AS (SELECT radius, unnest([{METRIC_LIST}]) AS metric, unnest([{', '.join(f'{c}::DOUBLE' for c in stability.METRICS)}]) AS v FROM dx) SELECT radius, metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(quantile_cont(v, 0.025), 6) AS q025, round(quantile_cont(v, 0.975), 6) AS q975 FROM l GROUP BY ALL")
def _(spark, d):
    return rounded(stability.summarise_by_radius(diagnostics(spark, d), stability.METRICS), "mean", "sd", "q025", "q975")


SAMPLE = "sample AS (SELECT id FROM points ORDER BY md5(id || ':7'), id LIMIT 256)"


@R.add("i29_audit_sample", f"WITH {POINTS}, {SAMPLE} SELECT id FROM sample")
def _(spark, d):
    return stability.audit_sample(points(spark, d), "id", 256, 7)


def _jaccard(sets, name):
    return f""", {name}n AS (SELECT radius, replicate, count(*) AS n FROM {sets} GROUP BY ALL), {name}z AS (SELECT radius, replicate, coalesce(n, 0) AS n FROM cfg LEFT JOIN {name}n USING (radius, replicate)),
{name}i AS (SELECT a.radius, a.replicate AS ra, b.replicate AS rb, count(*) AS i FROM {sets} a JOIN {sets} b ON a.radius = b.radius AND a.e = b.e AND a.replicate < b.replicate GROUP BY ALL),
{name}j AS (SELECT x.radius, CASE WHEN x.n + y.n = 0 THEN 1 ELSE coalesce(i, 0) / (x.n + y.n - coalesce(i, 0)) END AS j FROM {name}z x JOIN {name}z y ON x.radius = y.radius AND x.replicate < y.replicate LEFT JOIN {name}i t ON t.radius = x.radius AND t.ra = x.replicate AND t.rb = y.replicate)"""


LANDMARK_SETS = ", ls AS (SELECT radius, replicate, landmark AS e FROM gballs)" + _jaccard("ls", "l_")
PAIR_SETS = f", {SAMPLE}, sm AS (SELECT * FROM gm WHERE unit IN (SELECT id FROM sample)), pss AS (SELECT DISTINCT a.radius, a.replicate, (a.unit, b.unit) AS e FROM sm a JOIN sm b ON a.radius = b.radius AND a.replicate = b.replicate AND a.ball_id = b.ball_id AND a.unit < b.unit)" + _jaccard("pss", "p_")
STABLE = ("mean", "median", "q10", "min")


def _stable(name, t):
    return f"round(avg(j), 6) AS {name}_mean, round(median(j), 6) AS {name}_median, round(quantile_cont(j, 0.1), 6) AS {name}_q10, round(min(j), 6) AS {name}_min FROM {t} GROUP BY radius"


def sampled(p):
    """The 256 units whose pairs stand for all, with their axes."""
    return p.join(F.broadcast(stability.audit_sample(p, "id", 256, 7)), "id")


@R.add("i28_landmark_stability", f"WITH RECURSIVE {WIDE_GRID}{LANDMARK_SETS} SELECT radius, count(*) AS n_pairs, " + _stable("landmark", "l_j"))
def _(spark, d):
    s = wide(spark, d)[1]
    bits = sweep.element_bits(s.balls().select("radius", "replicate", "landmark"), "landmark")
    return rounded(stability.bit_stability(bits, s.work.select(F.explode("radii").alias("radius"), "replicate"), "landmark"), *[f"landmark_{x}" for x in STABLE])


@R.add("i28_cover_stability", f"WITH RECURSIVE {WIDE_GRID}{PAIR_SETS} SELECT radius, count(*) AS n_pairs, " + _stable("cover", "p_j"))
def _(spark, d):
    p, s = wide(spark, d)
    return rounded(stability.bit_stability(s.pair_bits(sampled(p)), s.work.select(F.explode("radii").alias("radius"), "replicate"), "cover"), *[f"cover_{x}" for x in STABLE])


MEDIANS = ", ".join(f"median({c}) AS {c}_median" for c in stability.METRICS)
RATES = ", ".join(f"avg({c}::INT) AS {c}_rate" for c in stability.FLAGS)
SPREADS = ", ".join(f"quantile_cont({c}, {p}) AS {c}_{n}" for c in stability.SPREAD for p, n in ((0.1, "q10"), (0.9, "q90")))
SUMMARY = f"""{PAIR_SETS}{LANDMARK_SETS}, sy AS (SELECT radius_index, radius, count(*) AS n_runs, max(n_units) AS n_units, {MEDIANS}, {SPREADS}, stddev_samp(n_balls) AS n_balls_sd, {RATES} FROM dx GROUP BY ALL),
st AS (SELECT * FROM (SELECT radius, count(*) AS n_pairs, avg(j) AS cover_mean, median(j) AS cover_median, quantile_cont(j, 0.1) AS cover_q10, min(j) AS cover_min FROM p_j GROUP BY radius) JOIN (SELECT radius, avg(j) AS landmark_mean, median(j) AS landmark_median, quantile_cont(j, 0.1) AS landmark_q10, min(j) AS landmark_min FROM l_j GROUP BY radius) USING (radius)),
su AS (SELECT * FROM sy JOIN st USING (radius))"""
SU = DX + SUMMARY


def summary(spark, d):
    p, s = wide(spark, d)
    return stability.diagnostic_summary(stability.cover_diagnostics(s.counts(), WIDE), stability.sweep_stability(s, sampled(p)))


REAL = [f"{c}_median" for c in stability.METRICS] + [f"{c}_{n}" for c in stability.SPREAD for n in ("q10", "q90")] + ["n_balls_sd"] + [f"{c}_rate" for c in stability.FLAGS] + [f"{k}_{x}" for k in ("cover", "landmark") for x in STABLE]


@R.add("i27_diagnostic_summary", SU + f" SELECT radius_index, radius, n_runs, n_units, n_pairs, {', '.join(f'round({c}, 6) AS {c}' for c in REAL)} FROM su")
def _(spark, d):
    return rounded(summary(spark, d), *REAL)


GAP = "sqrt((a.z1-b.z1)*(a.z1-b.z1) + (a.z2-b.z2)*(a.z2-b.z2) + (a.z3-b.z3)*(a.z3-b.z3))"
PAIRWISE = f"ap AS (SELECT a.id AS i, b.id AS j, {GAP} AS d FROM points a JOIN points b ON a.id < b.id)"
NEAREST = "nn AS (SELECT i, min(d) AS d FROM (SELECT i, d FROM ap UNION ALL SELECT j, d FROM ap) GROUP BY i HAVING min(d) > 0)"


@R.add(
    "i30_distance_diagnostics",
    f"""WITH {POINTS}, {SAMPLE}, {PAIRWISE}, {NEAREST}, sp AS (SELECT d FROM ap WHERE i IN (SELECT id FROM sample) AND j IN (SELECT id FROM sample)),
x AS (SELECT count(*) FILTER (d = 0) AS n_duplicates, round(min(d) FILTER (d > 0), 6) AS min_positive, round(max(d), 6) AS max FROM ap),
y AS (SELECT round(min(d), 6) AS nn_min, round(max(d), 6) AS nn_max, {', '.join(f'round(quantile_cont(d, {q}), 6) AS {c}' for c, q in stability.NN_LEVELS.items())} FROM nn),
z AS (SELECT {', '.join(f'round(quantile_cont(d, {q}), 6) AS {c}' for c, q in stability.PAIR_LEVELS.items())} FROM sp)
SELECT (SELECT count(*) FROM points) AS n_units, x.*, y.*, z.* FROM x, y, z""",
)
def _(spark, d):
    return rounded(stability.distance_diagnostics(points(spark, d), "id", AXES), "min_positive", "max", "nn_min", "nn_max", *stability.NN_LEVELS, *stability.PAIR_LEVELS)


@R.add("i31_radius_grid", f"WITH {POINTS}, {PAIRWISE}, e AS (SELECT 0.75 * min(d) FILTER (d > 0) AS lo, (1 + 1e-9) * max(d) AS hi FROM ap) SELECT i::INT AS radius_index, round(lo * pow(hi / lo, (i - 1) / 10.0), 6) AS radius FROM e, range(1, 12) r(i)")
def _(spark, d):
    return rounded(stability.geometric_grid(stability.distance_diagnostics(points(spark, d), "id", AXES), 11), "radius")


FROM_START = "CASE WHEN radius >= start AND one_ball_rate < 0.5 THEN {} END"
CROSSED = f""", rw AS (SELECT radius, largest_share_median AS s, lag(radius) OVER (ORDER BY radius) AS r0, lag(largest_share_median) OVER (ORDER BY radius) AS s0 FROM su),
cx AS (SELECT target, arg_min((radius, s, r0, s0), radius) FILTER (s >= target) AS x FROM rw, (VALUES (0.4::DOUBLE), (0.5), (0.6), (0.75)) v(target) GROUP BY target),
ct AS (SELECT target, x[1] AS r1, x[2] AS s1, x[3] AS r0, x[4] AS s0, CASE WHEN x IS NULL OR x[1] IS NULL THEN 'NO_CROSSING_IN_GRID' WHEN x[3] IS NULL THEN 'CROSSING_AT_OR_BELOW_GRID_MINIMUM' WHEN x[2] <= x[4] THEN 'NONMONOTONE_LOCAL_SHARE_USED_UPPER_BRACKET' ELSE 'LOG_RADIUS_INTERPOLATED' END AS status FROM cx),
cr AS (SELECT *, CASE WHEN status = 'LOG_RADIUS_INTERPOLATED' THEN exp(ln(r0) + (target - s0) / (s1 - s0) * (ln(r1) - ln(r0))) ELSE r1 END AS ref FROM ct),
rf AS (SELECT (SELECT ref FROM cr WHERE target = 0.5) AS ref, (SELECT CASE WHEN count(ref) = 2 THEN min(ref) END FROM cr WHERE target IN (0.4, 0.6)) AS lo, (SELECT CASE WHEN count(ref) = 2 THEN max(ref) END FROM cr WHERE target IN (0.4, 0.6)) AS hi)"""
FIRST = "min(radius) FILTER ({})"
REPORT = [FIRST.format("radius = start")] + [f"arg_min(radius, ({FROM_START.format(c)}, radius)) FILTER (radius >= start AND one_ball_rate < 0.5)" for c in ("round(cover_mean, 9)", "round(-share_multicovered_median, 9)")] + [FIRST.format(c) for c in ("connected_rate >= 0.5", "connected_rate >= 0.95", "none_isolated_rate >= 0.5", "none_isolated_rate >= 0.95", "n_balls_median <= 20", "n_balls_median <= 10", "n_balls_median <= 5", "one_ball_rate >= 0.5")]


@R.add("i32_transition_report", SU + ", s0 AS (SELECT *, (SELECT min(radius) FROM su WHERE share_multicovered_median > 0 OR n_edges_median > 0 OR n_balls_median < n_units) AS start FROM su) " + " UNION ALL ".join(f"SELECT '{k}' AS transition, coalesce({r}, -1) AS radius, '{role}' AS role FROM s0" for (k, role), r in zip(stability.TRANSITIONS.items(), REPORT, strict=True)))
def _(spark, d):
    return stability.transition_report(summary(spark, d)).fillna(-1.0, ["radius"])


@R.add("i32_dominance_crossings", SU + CROSSED + " SELECT target, round(ref, 6) AS reference_radius, r0 AS lower_radius, r1 AS upper_radius, round(s0, 6) AS lower_share, round(s1, 6) AS upper_share, status, round(ref / sqrt(3), 6) AS radius_per_root_axes, CASE WHEN target = 0.5 THEN 'PRIMARY' ELSE 'SENSITIVITY' END AS role FROM cr")
def _(spark, d):
    return rounded(stability.dominance_crossings(summary(spark, d), 3), "reference_radius", "lower_share", "upper_share", "radius_per_root_axes")


NEAREST = "x AS (SELECT arg_min((radius, n_balls_median, effective_balls_median, largest_share_median, cover_mean), (round(abs(ln(radius) - ln(ref)), 12), radius)) AS x FROM su, rf)"


@R.add("i32_resolution_reference", SU + CROSSED + f", {NEAREST} SELECT round(ref, 6) AS reference_radius, round(ref / sqrt(3), 6) AS radius_per_root_axes, round(lo, 6) AS band_lower, round(hi, 6) AS band_upper, x[1] AS nearest_radius, x[2] AS nearest_n_balls_median, round(x[3], 6) AS nearest_effective_balls_median, round(x[4], 6) AS nearest_largest_share_median, round(x[5], 6) AS nearest_cover_mean FROM rf, x")
def _(spark, d):
    s = scratch.cut(summary(spark, d))
    return rounded(stability.resolution_reference(s, stability.dominance_crossings(s, 3)), "reference_radius", "radius_per_root_axes", "band_lower", "band_upper", "nearest_effective_balls_median", "nearest_largest_share_median", "nearest_cover_mean")


PROPOSED = 1.5


def reviewed(spark, d):
    s = scratch.cut(summary(spark, d))
    return s, stability.radius_review(stability.resolution_reference(s, stability.dominance_crossings(s, 3)), PROPOSED, 3)


@R.add("i33_radius_review", SU + CROSSED + f" SELECT {PROPOSED}::DOUBLE AS proposed, round({PROPOSED} / sqrt(3), 6) AS radius_per_root_axes, round(ref, 6) AS reference_radius, round(abs({PROPOSED} - ref) / ref, 6) AS relative_difference, round(lo, 6) AS band_lower, round(hi, 6) AS band_upper, coalesce({PROPOSED} BETWEEN lo AND hi, false) AS inside_band, CASE WHEN lo IS NULL THEN 'NO_BAND' WHEN {PROPOSED} < lo THEN 'BELOW_BAND' WHEN {PROPOSED} > hi THEN 'ABOVE_BAND' ELSE 'INSIDE_BAND' END AS position, false AS approved FROM rf")
def _(spark, d):
    return rounded(reviewed(spark, d)[1], "radius_per_root_axes", "reference_radius", "relative_difference", "band_lower", "band_upper")


CHECKS = {
    "integrity": {"exact_radius_evaluated": "count(*) = 1", "exact_radius_positive": "max(radius) > 0", "one_ball_rate_bounded": "max(one_ball_rate) BETWEEN 0 AND 1", "median_balls_at_least_one": "max(n_balls_median) >= 1", "median_effective_balls_at_least_one": "round(max(effective_balls_median), 9) >= 1", "largest_share_bounded": "max(largest_share_median) BETWEEN 0 AND 1", "cover_stability_bounded": "max(cover_mean) BETWEEN 0 AND 1", "band_valid": "max(lo) > 0 AND max(hi) > max(lo)", "not_approved_by_itself": "true"},
    "flag": {"outside_band": f"NOT coalesce({PROPOSED} BETWEEN max(lo) AND max(hi), false)", "one_ball_observed": "max(one_ball_rate) > 0", "median_balls_at_most_one": "max(n_balls_median) <= 1", "median_effective_balls_at_most_one": "round(max(effective_balls_median), 9) <= 1", "dominant_ball": "max(largest_share_median) >= 0.75", "some_covers_not_connected": "max(connected_rate) < 1", "some_balls_isolated": "max(none_isolated_rate) < 1"},
}


@R.add("i33_review_checks", SU + CROSSED + " " + " UNION ALL ".join(f"SELECT '{kind}' AS kind, '{name}' AS name, coalesce({how}, false) AS outcome FROM su, rf WHERE radius = {PROPOSED}" for kind, group in CHECKS.items() for name, how in group.items()))
def _(spark, d):
    return stability.review_checks(*reviewed(spark, d))


ISOLATED = ", ge AS (SELECT DISTINCT a.radius, a.replicate, a.ball_id FROM gm a JOIN gm b ON a.radius = b.radius AND a.replicate = b.replicate AND a.unit = b.unit AND a.ball_id <> b.ball_id), iso AS (SELECT radius, replicate, ball_id FROM gballs EXCEPT SELECT * FROM ge)"


def isolated(b, m):
    e = cover.edges(m, ["radius", "replicate"])
    ends = e.select("radius", "replicate", F.col("a").alias("ball_id")).unionByName(e.select("radius", "replicate", F.col("b").alias("ball_id"))).distinct()
    return b.select("radius", "replicate", "ball_id").join(ends, ["radius", "replicate", "ball_id"], "left_anti")


MEM = ISOLATED + ", ru AS (SELECT radius, replicate, unit, count(*) AS n, count(iso.ball_id) AS k FROM gm LEFT JOIN iso USING (radius, replicate, ball_id) GROUP BY ALL), ms AS (SELECT radius, unit, round(avg(n), 6) AS mean_memberships, round(avg(k), 6) AS mean_isolated, round(avg((n = k)::INT), 6) AS isolation_frequency FROM ru GROUP BY ALL)"


@R.add("i34_membership_stability", G + MEM + " SELECT * FROM ms")
def i34(spark, d):
    _, b, m = grid(spark, d)
    return rounded(stability.membership_stability(m, isolated(b, m)), "mean_memberships", "mean_isolated", "isolation_frequency")


@R.add("i36_focal_tables", G + MEM + " SELECT ms.*, label FROM ms JOIN points ON unit = id WHERE unit % 20 = 0")
def _(spark, d):
    labels = points(spark, d).select(F.col("id").alias("unit"), "label").where("unit % 20 = 0")
    return i34(spark, d).join(labels, "unit")


@R.add(
    "i35_comembership_frequency",
    G + f", {SAMPLE}, sm AS (SELECT * FROM gm WHERE unit IN (SELECT id FROM sample)), s AS (SELECT DISTINCT a.radius, a.replicate, a.unit AS id1, b.unit AS id2 FROM sm a JOIN sm b ON a.radius = b.radius AND a.replicate = b.replicate AND a.ball_id = b.ball_id AND a.unit < b.unit) SELECT radius, id1, id2, count(*) AS runs_together, round(count(*) / 3, 6) AS frequency FROM s GROUP BY ALL",
)
def _(spark, d):
    p, b, m = grid(spark, d)
    sample = stability.audit_sample(p, "id", 256, 7).withColumnRenamed("id", "unit")
    return rounded(stability.comembership_frequency(stability.comembership(m.join(F.broadcast(sample), "unit")), b.select("radius", "replicate").distinct()), "frequency")


CANON = GRID + COVER[len(POINTS) :] + ", bm AS (SELECT ball_id, avg(a1) AS a1 FROM member JOIN points ON unit = id GROUP BY ball_id), canon AS (SELECT unit, avg(a1) AS c FROM member JOIN bm USING (ball_id) GROUP BY unit), ps AS (SELECT radius, unit, avg(a1) AS mean, stddev_samp(a1) AS sd, quantile_cont(a1, 0.1) AS q10, quantile_cont(a1, 0.9) AS q90 FROM glocal GROUP BY ALL)"
K = f"WITH RECURSIVE {CANON} "


def colours(spark, d):
    """(local colours over the grid, canonical ones) of a1."""
    p, _, m = grid(spark, d)
    return cover.local_colour(m, p, "id", ["a1"], ["radius", "replicate"]), cover.local_colour(canonical(spark, d)[2], p, "id", ["a1"])


#: Readouts: the axes and a column for each category.
LEVELS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
READOUTS = ["a1", "a2", "a3", *[f"category_{v}" for v in LEVELS]]
ALL = f"""{CANON}, lv AS (SELECT id, unnest([{', '.join(f"'{c}'" for c in READOUTS)}]) AS variable, unnest([a1::DOUBLE, a2::DOUBLE, a3::DOUBLE, {', '.join(f"(category = '{v}')::INT::DOUBLE" for v in LEVELS)}]) AS v FROM points),
gb2 AS (SELECT radius, replicate, ball_id, variable, avg(v) AS m FROM gm JOIN lv ON unit = id GROUP BY ALL), gl2 AS (SELECT radius, replicate, unit, variable, avg(m) AS v FROM gm JOIN gb2 USING (radius, replicate, ball_id) GROUP BY ALL),
cb2 AS (SELECT ball_id, variable, avg(v) AS m FROM member JOIN lv ON unit = id GROUP BY ALL), cl2 AS (SELECT unit, variable, avg(m) AS c FROM member JOIN cb2 USING (ball_id) GROUP BY ALL),
rb AS (SELECT variable, radius, replicate, sqrt(avg((v - c) ** 2)) AS rmse, avg(abs(v - c)) AS mae, corr(v, c) AS pearson FROM gl2 JOIN cl2 USING (unit, variable) GROUP BY ALL)"""


def robustness(spark, d):
    p, _, m = grid(spark, d)
    p = scale.one_hot(p, "category")
    return stability.colour_robustness(cover.local_colour(m, p, "id", READOUTS, ["radius", "replicate"]), cover.local_colour(canonical(spark, d)[2], p, "id", READOUTS), READOUTS)


@R.add("i37_colour_robustness", f"WITH RECURSIVE {ALL} SELECT variable, radius, replicate, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(pearson, 6) AS pearson FROM rb")
def i37(spark, d):
    return rounded(robustness(spark, d), "rmse", "mae", "pearson")


QS = ", ".join(f"round({'median(' + c + ')' if n == 'median' else f'quantile_cont({c}, {p})'}, 6) AS {c}_{n}" for c in ("rmse", "mae", "pearson") for n, p in (("median", 0.5), ("q10", 0.1), ("q90", 0.9)))


@R.add("i37_by_radius", f"WITH RECURSIVE {ALL} SELECT variable, radius, count(*) AS n_runs, {QS} FROM rb GROUP BY ALL")
def _(spark, d):
    rows = stability.robustness_by_radius(robustness(spark, d))
    return rounded(rows, *[c for c, kind in rows.dtypes if kind == "double" and c != "radius"])


@R.add("i38_point_stability", K + "SELECT radius, unit, round(mean, 6) AS mean, round(sd, 6) AS sd, round(q10, 6) AS q10, round(q90, 6) AS q90 FROM ps")
def _(spark, d):
    return rounded(stability.point_stability(colours(spark, d)[0], "a1"), "mean", "sd", "q10", "q90")


@R.add("i39_pattern_vs_reference", K + "SELECT x.radius, round(sqrt(avg((x.mean - y.mean) ** 2)), 6) AS rmse, round(corr(x.mean, y.mean), 6) AS pearson FROM ps x JOIN ps y ON x.unit = y.unit AND y.radius = 1.5 GROUP BY ALL")
def _(spark, d):
    return rounded(stability.pattern_vs_reference(stability.point_stability(colours(spark, d)[0], "a1"), 1.5), "rmse", "pearson")


@R.add("i40_order_robustness", K + "SELECT radius, round(avg(abs(c - mean)), 6) AS mean_abs_difference, round(avg((round(c, 9) BETWEEN round(q10, 9) AND round(q90, 9))::INT), 6) AS share_inside FROM ps JOIN canon USING (unit) GROUP BY radius")
def _(spark, d):
    local, canon = colours(spark, d)
    p = stability.point_stability(local, "a1")
    return rounded(stability.order_robustness(rounded(p, "q10", "q90", digits=9), rounded(canon, "a1", digits=9), "a1"), "mean_abs_difference", "share_inside")


@R.add("i41_family_robustness", f"WITH RECURSIVE {ALL} SELECT CASE WHEN variable LIKE 'category%' THEN 'category' ELSE variable END AS family, count(*) AS n, round(min(pearson), 6) AS worst, round(median(pearson), 6) AS median FROM rb GROUP BY family")
def _(spark, d):
    return rounded(stability.family_robustness(robustness(spark, d), "^(category)_"), "worst", "median")


WIN = ", l AS (SELECT radius, unnest(['n_balls', 'mean_size']) AS metric, unnest([n_balls::DOUBLE, mean_size]) AS v FROM runs WHERE radius BETWEEN 1.45 AND 1.65)"


@R.add("i42_window_summary", G + WIN + " SELECT metric, round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v) FILTER (radius = 1.5), 6) AS at_nearest FROM l GROUP BY metric")
def _(spark, d):
    p, _, m = grid(spark, d)
    return rounded(stability.window_summary(runs(p, m), ["n_balls", "mean_size"], 1.45, 1.65, 1.49))


@R.add("e12_cross_radius_range", G + "SELECT replicate, min(n_balls) AS low, max(n_balls) AS high, bool_and(n_balls > 0) AS all_nonzero FROM runs GROUP BY replicate")
def _(spark, d):
    p, _, m = grid(spark, d)
    return stability.cross_radius_range(runs(p, m), "n_balls")


RUNS = [
    {"run_id": "r1", "dataset": "all", "axes": AXES, "colour": "a1", "radius_min": 1.4, "radius_max": 1.6, "radius_step": 0.1, "repetitions": 3, "tier": 1},
    {"run_id": "r2", "dataset": "all", "axes": AXES, "colour": "a2", "radius_min": 1.5, "radius_max": 1.6, "radius_step": 0.1, "repetitions": 2, "tier": 1},
    {"run_id": "r3", "dataset": "all", "axes": AXES[:2], "colour": "a3", "radius_min": 1.0, "radius_max": 1.5, "radius_step": 0.25, "repetitions": 2, "tier": 2},
]
OUTCOME = "SELECT '{run}' AS run_id, radius, replicate, count(*) AS n_balls, round(min(m), 6) AS min_colour, round(max(m), 6) AS max_colour, round(stddev_samp(m), 6) AS sd_colour, round(avg(n), 6) AS mean_size, round(avg(s) FILTER (n > 1), 6) AS within_sd, round(avg(r) FILTER (n > 1), 6) AS within_range FROM (SELECT radius, replicate, ball_id, avg({c}) AS m, count(*) AS n, stddev_samp({c}) AS s, max({c}) - min({c}) AS r FROM gm JOIN points ON unit = id GROUP BY ALL) WHERE {rows} GROUP BY ALL"


@R.add("i43_run_matrix", G + OUTCOME.format(run="r1", c="a1", rows="true") + " UNION ALL " + OUTCOME.format(run="r2", c="a2", rows="radius >= 1.5 AND replicate <= 2"))
def _(spark, d):
    p = scratch.cut(points(spark, d))
    return rounded(stability.run_matrix({"all": p}, RUNS, tiers=[1]), "min_colour", "max_colour", "sd_colour", "mean_size", "within_sd", "within_range")


def grid_on(name: str, end: str) -> str:
    """The grid's SQL over another table of points, its tables with another ending."""
    return re.sub(r"\b(points|cfg|opts|garr|gstep|gballs|gm|gsize|runs|gbm|glocal)\b", lambda m: name if m[1] == "points" else m[1] + end, GRID[len(POINTS) :])


SWEEP = {"primary": {}, "without_machinery": {"exclude": ("category", ["MACHINERY"])}, "robust": {"scaling": "mad"}}
SCENARIOS = f"""{GRID}, kept AS (SELECT * FROM units WHERE category <> 'MACHINERY'),
p2 AS (SELECT id, a1, {', '.join(f'round((a{i} - avg(a{i}) OVER ()) / stddev_samp(a{i}) OVER (), 9) AS z{i}' for i in (1, 2, 3))} FROM kept),
off AS (SELECT id, a1, {', '.join(f'a{i} - median(a{i}) OVER () AS o{i}' for i in (1, 2, 3))} FROM units),
p3 AS (SELECT id, a1, {', '.join(f'round(o{i} / (1.4826 * median(abs(o{i})) OVER ()), 9) AS z{i}' for i in (1, 2, 3))} FROM off){grid_on('p2', '2')}{grid_on('p3', '3')}"""
SHARES = "SELECT '{0}' AS scenario, radius, replicate, (SELECT count(*) FROM {1}) AS n_units, n_balls, round(largest_share, 6) AS largest_share FROM {2} WHERE radius = 1.5 AND replicate <= 2"
AUDIT = "SELECT '{0}' AS scenario, '{1}' AS scaling, (SELECT count(*) FROM units) AS n_before, (SELECT count(*) FROM units) - (SELECT count(*) FROM {2}) AS n_removed, (SELECT count(*) FROM {2}) AS n_after"


def scenarios(spark, d):
    return stability.scenario_points(units(spark, d), {"a1": "z1", "a2": "z2", "a3": "z3"}, SWEEP)


@R.add("i62_scenario_sweep", f"WITH RECURSIVE {SCENARIOS} " + " UNION ALL ".join(SHARES.format(*x) for x in (("primary", "points", "runs"), ("without_machinery", "p2", "runs2"), ("robust", "p3", "runs3"))))
def _(spark, d):
    return rounded(stability.scenario_sweep(scenarios(spark, d), AXES, [1.5], [1, 2]), "largest_share")


@R.add("i42_robustness_delta", f"WITH RECURSIVE {SCENARIOS}, sc AS (" + " UNION ALL ".join(SHARES.format(*x) for x in (("primary", "points", "runs"), ("without_machinery", "p2", "runs2"), ("robust", "p3", "runs3"))) + "), me AS (SELECT scenario, unnest(['n_balls', 'largest_share']) AS metric, unnest([n_balls::DOUBLE, largest_share]) AS v FROM sc), mm AS (SELECT scenario, metric, avg(v) AS mean FROM me GROUP BY ALL) SELECT a.scenario, metric, round(a.mean, 6) AS mean, round(a.mean - b.mean, 6) AS difference, round(abs(a.mean - b.mean), 6) AS absolute, round((a.mean - b.mean) / abs(b.mean), 6) AS relative FROM mm a JOIN mm b USING (metric) WHERE b.scenario = 'primary'")
def _(spark, d):
    rows = rounded(stability.scenario_sweep(scenarios(spark, d), AXES, [1.5], [1, 2]), "largest_share")
    means = stats.long(rows, ["scenario"], ["n_balls", "largest_share"], "metric").groupBy("scenario", "metric").agg(F.avg("value").alias("mean"))
    return rounded(stability.robustness_delta(means, "scenario", "primary"))


@R.add("i62_sweep_audit", f"WITH {UNITS} " + " UNION ALL ".join(AUDIT.format(*x) for x in (("primary", "z", "units"), ("without_machinery", "z", "(SELECT * FROM units WHERE category <> 'MACHINERY')"), ("robust", "mad", "units"))))
def _(spark, d):
    return stability.scenario_audit(units(spark, d), scenarios(spark, d), SWEEP)


BALLZ = ", bz AS (SELECT ball_id, avg(z1) AS z1, avg(z2) AS z2, avg(z3) AS z3 FROM member JOIN points ON unit = id GROUP BY ball_id), sc AS (SELECT *, (z1 + z2 + z3) / 3 AS s FROM bz), pr AS (SELECT x.ball_id AS a, y.ball_id AS b, abs(x.s - y.s) AS score_gap, sqrt((x.z1-y.z1)**2 + (x.z2-y.z2)**2 + (x.z3-y.z3)**2) AS axis_distance, sqrt((x.z1-x.s-y.z1+y.s)**2 + (x.z2-x.s-y.z2+y.s)**2 + (x.z3-x.s-y.z3+y.s)**2) AS profile_distance, x.z1 - y.z1 AS d1, x.z2 - y.z2 AS d2, x.z3 - y.z3 AS d3, (abs(x.z1) > 0.1 AND abs(y.z1) > 0.1 AND sign(x.z1) <> sign(y.z1))::INT + (abs(x.z2) > 0.1 AND abs(y.z2) > 0.1 AND sign(x.z2) <> sign(y.z2))::INT + (abs(x.z3) > 0.1 AND abs(y.z3) > 0.1 AND sign(x.z3) <> sign(y.z3))::INT AS sign_disagreements FROM sc x JOIN sc y ON x.ball_id < y.ball_id)"
C = f"WITH RECURSIVE {COVER}{BALLZ} "


def ball_axes(spark, d):
    p, _, m = canonical(spark, d)
    return cover.ball_means(m, p, "id", AXES), cover.edges(m)


MIX = ", mx AS (SELECT ball_id, category, count(*) / sum(count(*)) OVER (PARTITION BY ball_id) AS p FROM member JOIN points ON unit = id GROUP BY ball_id, category), tv AS (SELECT x.ball_id AS a, y.ball_id AS b, sum(least(x.p, y.p)) AS c FROM mx x JOIN mx y ON x.category = y.category AND x.ball_id < y.ball_id GROUP BY ALL)"


@R.add("i47_contrasts", C.rstrip() + MIX + " SELECT a, b, round(score_gap, 6) AS score_gap, round(axis_distance, 6) AS axis_distance, round(profile_distance, 6) AS profile_distance, sign_disagreements, score_gap <= 0.25 AND profile_distance >= 1 AS candidate, coalesce(strength, 0) AS strength, round(1 - coalesce(c, 0), 6) AS category_variation FROM pr LEFT JOIN edge USING (a, b) LEFT JOIN tv USING (a, b)")
def _(spark, d):
    p, _, m = canonical(spark, d)
    mix = profile.category_mix(m, p, "id", "category")
    variation = stats.total_variation(mix.withColumnRenamed("ball_id", "ball"), "ball", "level", "share").withColumnRenamed("total_variation", "category_variation")
    return rounded(contrast.contrasts(cover.ball_means(m, p, "id", AXES), AXES, cover.edges(m)).join(variation, ["a", "b"]))


GAPS, DISTANCES = [0.05, 0.1, 0.15, 0.2, 0.25, 0.3], [1.0, 1.5, 2.0, 2.5, 3.0]


@R.add("i48_threshold_grid", C + "SELECT g::DOUBLE AS gap, x::DOUBLE AS distance, count(*) AS n_pairs, count(*) FILTER (score_gap < g AND axis_distance > x) AS n_qualifying FROM pr, (VALUES (0.05), (0.1), (0.15), (0.2), (0.25), (0.3)) v(g), (VALUES (1), (1.5), (2), (2.5), (3)) w(x) GROUP BY ALL")
def _(spark, d):
    return contrast.threshold_grid(contrast.contrasts(ball_axes(spark, d)[0], AXES), GAPS, DISTANCES)


WEIGHTS = ", sch AS (SELECT i * 21 + j AS scheme, i / 20 AS w1, j / 20 AS w2, (20 - i - j) / 20 AS w3 FROM range(0, 21) a(i), range(0, 21) b(j) WHERE i + j <= 20), wp AS (SELECT scheme, round(least(w1, w2, w3), 6) AS lw, a, b, round(abs(d1 * w1 + d2 * w2 + d3 * w3), 9) AS gap, axis_distance AS ad FROM pr, sch)"


@R.add("i49_weight_sensitivity", C + WEIGHTS + " SELECT scheme, lw AS least_weight, count(*) FILTER (gap < 0.25 AND ad > 1) AS n_1, count(*) FILTER (gap < 0.25 AND ad > 2) AS n_2, count(*) FILTER (gap < 0.25 AND ad > 3) AS n_3 FROM wp GROUP BY ALL")
def _(spark, d):
    return contrast.weight_sensitivity(contrast.weighted_pairs(ball_axes(spark, d)[0], AXES, contrast.weight_simplex(spark)), 0.25, [1, 2, 3])


@R.add("i49_weight_subsets", C + WEIGHTS + ", se AS (SELECT scheme, lw, count(*) FILTER (gap < 0.25 AND ad > 1) AS n_1, count(*) FILTER (gap < 0.25 AND ad > 2) AS n_2, count(*) FILTER (gap < 0.25 AND ad > 3) AS n_3 FROM wp GROUP BY ALL), lo AS (SELECT b::DOUBLE AS least_weight, unnest([1.0::DOUBLE, 2, 3]) AS distance, unnest([n_1, n_2, n_3]) AS n FROM se, (VALUES (0.0), (0.1), (0.2)) v(b) WHERE lw >= b) SELECT least_weight, distance, count(*) AS n_schemes, min(n) AS n_min, median(n) AS n_median, max(n) AS n_max FROM lo GROUP BY ALL")
def _(spark, d):
    each = contrast.weight_sensitivity(contrast.weighted_pairs(ball_axes(spark, d)[0], AXES, contrast.weight_simplex(spark)), 0.25, [1, 2, 3])
    return contrast.weight_subsets(each, [0.0, 0.1, 0.2], [1, 2, 3])


@R.add("i50_pair_frequency", C + WEIGHTS + " SELECT a, b, round(avg((gap < 0.25 AND ad > 1)::INT), 6) AS frequency FROM wp WHERE lw >= 0.2 GROUP BY ALL")
def _(spark, d):
    return rounded(contrast.pair_frequency(contrast.weighted_pairs(ball_axes(spark, d)[0], AXES, contrast.weight_simplex(spark)), 0.25, 1.0))


@R.add("e6_nearest_comparators", C + ", bw AS (SELECT a AS ball_id, b AS other, score_gap, axis_distance FROM pr UNION ALL SELECT b, a, score_gap, axis_distance FROM pr) SELECT ball_id, arg_min(other, (round(score_gap, 9), other)) AS nearest_by_score, arg_min(other, (round(axis_distance, 9), other)) AS nearest_by_profile FROM bw GROUP BY ball_id")
def _(spark, d):
    return contrast.nearest_comparators(contrast.contrasts(ball_axes(spark, d)[0], AXES))


CELLS = ", sc AS (SELECT *, (z1 + z2 + z3) / 3 AS s FROM gbm), pr AS (SELECT x.radius, x.replicate, abs(x.s - y.s) AS gap, sqrt((x.z1-y.z1)**2 + (x.z2-y.z2)**2 + (x.z3-y.z3)**2) AS ad FROM sc x JOIN sc y ON x.radius = y.radius AND x.replicate = y.replicate AND x.ball_id < y.ball_id), ce AS (SELECT radius, replicate, g::DOUBLE AS gap, x::DOUBLE AS distance, count(*) AS n_pairs, count(*) FILTER (pr.gap < g AND ad > x) AS n_qualifying FROM pr, (VALUES (0.05), (0.1), (0.15), (0.2), (0.25), (0.3)) v(g), (VALUES (1), (1.5), (2), (2.5), (3)) w(x) GROUP BY ALL), ma AS (SELECT radius, replicate, n_balls, n_pairs, n_qualifying, n_qualifying / n_pairs AS prevalence FROM ce JOIN runs USING (radius, replicate) WHERE gap = 0.25 AND distance = 1)"
SPREADS_OF = lambda c: f"round(median({c}), 6) AS {c}_median, round(quantile_cont({c}, 0.1), 6) AS {c}_q10, round(quantile_cont({c}, 0.9), 6) AS {c}_q90, round(min({c}), 6) AS {c}_min, round(max({c}), 6) AS {c}_max"
KEYS = ["radius", "replicate"]


def threshold_cells(spark, d):
    """(30 cells of each cover of the grid, its cell of gap 0.25 and distance 1 with the number of balls and the prevalence)."""
    p, b, m = grid(spark, d)
    found = contrast.contrasts(cover.ball_means(m, p, "id", AXES, KEYS), AXES, by=KEYS)
    cells = scratch.cut(contrast.threshold_grid(found, GAPS, DISTANCES, KEYS))
    balls = b.groupBy(*KEYS).agg(F.count("*").alias("n_balls"))
    main = cells.where("gap = 0.25 AND distance = 1").join(balls, KEYS).select(*KEYS, "n_balls", "n_pairs", "n_qualifying", (F.col("n_qualifying") / F.col("n_pairs")).alias("prevalence"))
    return cells, main


@R.add("i51_contrast_robustness", G + CELLS + " SELECT radius, replicate, n_balls, n_pairs, n_qualifying, round(prevalence, 6) AS prevalence FROM ma")
def _(spark, d):
    return rounded(threshold_cells(spark, d)[1], "prevalence")


@R.add("i51_threshold_cells", G + CELLS + " SELECT radius, replicate, gap, distance, n_pairs, n_qualifying FROM ce")
def _(spark, d):
    return threshold_cells(spark, d)[0]


@R.add("i51_by_cell", G + CELLS + f", cp AS (SELECT *, n_qualifying / n_pairs AS prevalence FROM ce) SELECT radius, gap, distance, count(*) AS n_runs, {SPREADS_OF('n_qualifying')}, {SPREADS_OF('prevalence')}, round(avg((n_qualifying > 0)::INT), 6) AS share_any FROM cp GROUP BY ALL")
def _(spark, d):
    return rounded(contrast.robustness_cells(threshold_cells(spark, d)[0]))


@R.add("i51_by_radius", G + CELLS + f" SELECT radius, count(*) AS n_runs, {SPREADS_OF('n_balls')}, {SPREADS_OF('n_qualifying')}, {SPREADS_OF('prevalence')} FROM ma GROUP BY radius")
def _(spark, d):
    return rounded(contrast.spread(threshold_cells(spark, d)[1], ["radius"], ["n_balls", "n_qualifying", "prevalence"]))


@R.add("i51_overall", G + CELLS + ", ev AS (SELECT replicate, bool_and(n_qualifying > 0) AS ok FROM ma GROUP BY replicate) SELECT unnest(['covers', 'share_of_orders_nonzero_at_all_radii', 'prevalence_min', 'prevalence_median', 'prevalence_max']) AS metric, unnest([count(*)::DOUBLE, (SELECT avg(ok::INT) FROM ev), round(min(prevalence), 6), round(median(prevalence), 6), round(max(prevalence), 6)]) AS value FROM ma")
def _(spark, d):
    return rounded(contrast.robustness_overall(threshold_cells(spark, d)[1]), "value")


PAIRS = f"""dr AS (SELECT k AS pair, n, ('0x' || substr(md5(k || ':a11'), 1, 12))::BIGINT % n AS i, ('0x' || substr(md5(k || ':b11'), 1, 12))::BIGINT % n AS j0 FROM range(0, 500000) r(k), (SELECT count(*) AS n FROM points)), pp AS (SELECT pair, i, CASE WHEN i = j0 THEN (j0 + 1) % n ELSE j0 END AS j FROM dr),
pos AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS p, {xy('id')} FROM points), ps AS (SELECT pair, a.id AS a, b.id AS b, round(sqrt((a.z1-b.z1)*(a.z1-b.z1) + (a.z2-b.z2)*(a.z2-b.z2) + (a.z3-b.z3)*(a.z3-b.z3)), 6) AS config_distance, round(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) / 1000, 6) AS km FROM pp JOIN pos a ON a.p = i JOIN pos b ON b.p = j)"""


def pair_distances(spark, d):
    p = stability.with_positions(points(spark, d).withColumns({"x": x_of(F.col("id")), "y": y_of(F.col("id"))}), "id").select("id", "position", "x", "y", *AXES)
    a = p.select([F.col(c).alias("a" if c == "id" else f"_a{c}") for c in p.columns])
    b = p.select([F.col(c).alias("b" if c == "id" else f"_b{c}") for c in p.columns])
    pairs = stability.pair_sample(p, 500_000, 11).join(a, F.col("i") == F.col("_aposition")).join(b, F.col("j") == F.col("_bposition"))
    gap = lambda cs: F.sqrt(squared([F.col(f"_a{c}") for c in cs], [F.col(f"_b{c}") for c in cs]))
    return pairs.select("pair", "a", "b", F.round(gap(AXES), 6).alias("config_distance"), F.round(gap(["x", "y"]) / 1000, 6).alias("km"))


SHARE = ", cm AS (SELECT m.unit AS a, n.unit AS b, count(*) AS c FROM member m JOIN member n ON m.ball_id = n.ball_id GROUP BY ALL)"


@R.add("i57_pair_sample", f"WITH RECURSIVE {COVER}, {PAIRS}{SHARE} SELECT ps.*, coalesce(c, 0)::INT AS shared FROM ps LEFT JOIN cm USING (a, b)")
def _(spark, d):
    return stability.shared_balls(pair_distances(spark, d), canonical(spark, d)[2], "a", "b")


def _deciles(on):
    return f"""SELECT '{on}' AS conditioning, least(1 + len(list_filter(list_sort(br)[2:], lambda q: {on} > q)), len(br) - 1)::INT AS bin, count(*) AS n, round(median(config_distance), 6) AS median_config, round(median(km), 6) AS median_km, round(avg(km), 6) AS mean_km, round(avg((km > 50)::INT), 6) AS share_50, round(avg((km > 100)::INT), 6) AS share_100, round(avg((shared > 0)::INT), 6) AS share_shared
FROM sp, (SELECT list_distinct(quantile_cont({on}, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])) AS br FROM ps) GROUP BY ALL"""


@R.add("i58_distance_deciles", f"WITH RECURSIVE {COVER}, {PAIRS}{SHARE}, sp AS (SELECT ps.*, coalesce(c, 0) AS shared FROM ps LEFT JOIN cm USING (a, b)) " + _deciles("config_distance") + " UNION ALL " + _deciles("km"))
def _(spark, d):
    rows, out = scratch.cut(stability.shared_balls(pair_distances(spark, d), canonical(spark, d)[2], "a", "b")), None
    for on in ("config_distance", "km"):
        binned = bins.quantile_bins(rows, on)
        far = lambda k: F.avg((F.col("km") > k).cast("double")).alias(f"share_{k}")
        found = binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg("km").alias("mean_km"), far(50), far(100), F.avg((F.col("shared") > 0).cast("double")).alias("share_shared"))
        for c, new in (("config_distance", "median_config"), ("km", "median_km")):
            found = found.join(scale.group_quantiles(binned, ["bin"], c, [0.5], "_q").select("bin", F.get("_q", F.lit(0)).alias(new)), "bin")
        found = found.withColumn("conditioning", F.lit(on))
        out = found if out is None else out.unionByName(found)
    return rounded(out)


def grounded(spark, d):
    p, b, m = canonical(spark, d)
    return p.select(F.col("id").alias("unit"), x_of(F.col("id")).alias("x"), y_of(F.col("id")).alias("y")), b, m


CENTRE = f", gx AS (SELECT ball_id, unit, {xy('unit')} FROM member), ce AS (SELECT ball_id, avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM gx GROUP BY ball_id)"


@R.add("i59_ball_spatial", f"WITH RECURSIVE {COVER}{CENTRE}, ds AS (SELECT ball_id, sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy)) / 1000 AS km FROM gx JOIN ce USING (ball_id)) SELECT ball_id, round(median(km), 6) AS median_km, round(quantile_cont(km, 0.9), 6) AS q90_km, round(max(km), 6) AS max_km FROM ds GROUP BY ball_id")
def _(spark, d):
    xy_, _, m = grounded(spark, d)
    return rounded(profile.ball_spread(m, xy_))


NEAR_KM = 2000.0
ADJACENT = f", pl AS (SELECT id, {xy('id')} FROM points), ad AS (SELECT p.id AS a, q.id AS b FROM pl p JOIN pl q ON p.id < q.id AND (p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y) <= {NEAR_KM**2})"


@R.add(
    "i59_ball_adjacency",
    f"""WITH RECURSIVE {COVER}{ADJACENT}, ins AS (SELECT m.ball_id, a, b FROM ad JOIN member m ON m.unit = a JOIN member n ON n.unit = b AND n.ball_id = m.ball_id), bw AS (SELECT ball_id, a, b FROM ins UNION ALL SELECT ball_id, b, a FROM ins),
re AS (SELECT ball_id, unit AS a, unit AS b FROM member UNION SELECT re.ball_id, re.a, bw.b FROM re JOIN bw ON re.ball_id = bw.ball_id AND re.b = bw.a), co AS (SELECT ball_id, a, min(b) AS c FROM re GROUP BY ALL), sz AS (SELECT ball_id, c, count(*) AS n FROM co GROUP BY ALL)
SELECT ball_id, sum(n)::BIGINT AS n_units, count(*) AS n_components, round(max(n) / sum(n), 6) AS largest_share, count(*) FILTER (n = 1) AS n_singletons, (SELECT count(*) FROM ins WHERE ins.ball_id = sz.ball_id) AS n_edges, round(2 * (SELECT count(*) FROM ins WHERE ins.ball_id = sz.ball_id) / sum(n), 6) AS mean_degree FROM sz GROUP BY ball_id""",
)
def _(spark, d):
    places, _, m = grounded(spark, d)
    return rounded(ground.ball_adjacency(m, places, NEAR_KM))


@R.add("i59_ball_moran", f"""WITH RECURSIVE {COVER}{ADJACENT}, bw AS (SELECT a AS u, b AS v FROM ad UNION ALL SELECT b, a FROM ad), un AS (SELECT DISTINCT u FROM bw), fl AS (SELECT ball_id, u, (EXISTS (SELECT 1 FROM member m WHERE m.unit = u AND m.ball_id = balls.ball_id))::INT AS f FROM un, balls),
z AS (SELECT ball_id, u, f - avg(f) OVER (PARTITION BY ball_id) AS z FROM fl), lg AS (SELECT x.ball_id, bw.u, avg(x.z) AS lag FROM bw JOIN z x ON x.u = bw.v GROUP BY ALL) SELECT z.ball_id, round(sum(z * lag) / sum(z * z), 6) AS moran FROM z JOIN lg ON lg.ball_id = z.ball_id AND lg.u = z.u GROUP BY z.ball_id""")
def _(spark, d):
    places, _, m = grounded(spark, d)
    return rounded(ground.membership_moran(m, places, NEAR_KM))


CROSS = f"{ADJACENT}, xr AS (SELECT DISTINCT least(m.ball_id, n.ball_id) AS a, greatest(m.ball_id, n.ball_id) AS b, ad.a AS u, ad.b AS v FROM ad JOIN member m ON m.unit = ad.a JOIN member n ON n.unit = ad.b AND m.ball_id <> n.ball_id), xc AS (SELECT a, b, count(*) AS n_cross FROM xr GROUP BY a, b)"


@R.add("i60_cross_adjacency", f"WITH RECURSIVE {COVER}{CROSS} SELECT * FROM xc")
def _(spark, d):
    places, _, m = grounded(spark, d)
    return ground.cross_adjacency(m, places, NEAR_KM)


@R.add(
    "i60_contrast_spatial",
    f"""WITH RECURSIVE {COVER}{CENTRE}{CROSS}, pq AS (SELECT x.ball_id AS a, y.ball_id AS b, gx.unit, gx.x, gx.y FROM balls x JOIN balls y ON x.ball_id < y.ball_id JOIN gx ON gx.ball_id = x.ball_id ANTI JOIN member k ON k.unit = gx.unit AND k.ball_id = y.ball_id),
qq AS (SELECT x.ball_id AS a, y.ball_id AS b, gx.x, gx.y FROM balls x JOIN balls y ON x.ball_id < y.ball_id JOIN gx ON gx.ball_id = y.ball_id ANTI JOIN member k ON k.unit = gx.unit AND k.ball_id = x.ball_id),
gp AS (SELECT pq.a, pq.b, unit, min(sqrt((pq.x-qq.x)*(pq.x-qq.x) + (pq.y-qq.y)*(pq.y-qq.y))) / 1000 AS km FROM pq JOIN qq ON pq.a = qq.a AND pq.b = qq.b GROUP BY ALL), gs AS (SELECT a, b, min(km) AS lo, median(km) AS mid FROM gp GROUP BY ALL)
SELECT x.ball_id AS a, y.ball_id AS b, coalesce(strength, 0) AS shared_members, round(coalesce(strength, 0) / (x.n + y.n - coalesce(strength, 0)), 6) AS jaccard, round(sqrt((x.cx-y.cx)**2 + (x.cy-y.cy)**2) / 1000, 6) AS centroid_km,
coalesce(round(lo, 6), -1) AS min_exclusive_km, coalesce(round(mid, 6), -1) AS median_exclusive_km, coalesce(n_cross, 0) AS n_cross
FROM ce x JOIN ce y ON x.ball_id < y.ball_id LEFT JOIN edge e ON e.a = x.ball_id AND e.b = y.ball_id LEFT JOIN gs ON gs.a = x.ball_id AND gs.b = y.ball_id LEFT JOIN xc ON xc.a = x.ball_id AND xc.b = y.ball_id""",
)
def _(spark, d):
    places, _, m = grounded(spark, d)
    found = profile.pair_spread(m, places).join(ground.exclusive_gaps(m, places), ["a", "b"], "left").join(ground.cross_adjacency(m, places, NEAR_KM), ["a", "b"], "left")
    return rounded(found, "jaccard", "centroid_km", "min_exclusive_km", "median_exclusive_km").fillna(-1.0, ["min_exclusive_km", "median_exclusive_km"]).fillna(0, ["n_cross"])
