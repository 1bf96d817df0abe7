"""Queries on one cover: balls, overlap graph, profiles, colours and mixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from coverscope.operators import bins, cover, graph, profile, scratch
from coverscope.plans.frames import AXES, POINTS, points
from coverscope.plans.registry import Registry
from coverscope.plans.statistics import rounded

R = Registry()
EPS = 1.5

COVER = (
    POINTS
    + f""",
pts AS (SELECT *, row_number() OVER (ORDER BY id) AS o FROM points),
arr AS (SELECT list(z1 ORDER BY o) AS x, list(z2 ORDER BY o) AS y, list(z3 ORDER BY o) AS z FROM pts),
step AS (SELECT 0::BIGINT AS ball_id, 0::BIGINT AS lm, list_transform(x, lambda v: false) AS cov FROM arr
  UNION ALL
  SELECT ball_id + 1, pos, list_transform(range(1, len(cov) + 1), lambda i: cov[i] OR (x[i]-x[pos])*(x[i]-x[pos]) + (y[i]-y[pos])*(y[i]-y[pos]) + (z[i]-z[pos])*(z[i]-z[pos]) <= {EPS * EPS})
  FROM (SELECT ball_id, cov, list_position(cov, false)::BIGINT AS pos FROM step), arr WHERE coalesce(pos, 0) > 0),
balls AS (SELECT ball_id, id AS landmark, z1, z2, z3 FROM step JOIN pts ON o = lm WHERE lm > 0),
member AS (SELECT b.ball_id, b.landmark, p.id AS unit FROM balls b JOIN points p ON (b.z1-p.z1)*(b.z1-p.z1) + (b.z2-p.z2)*(b.z2-p.z2) + (b.z3-p.z3)*(b.z3-p.z3) <= {EPS * EPS}),
edge AS (SELECT m.ball_id AS a, n.ball_id AS b, count(*) AS strength FROM member m JOIN member n ON m.unit = n.unit AND m.ball_id < n.ball_id GROUP BY ALL),
both_ways AS (SELECT a AS node, b AS other, strength FROM edge UNION ALL SELECT b, a, strength FROM edge),
reach AS (SELECT ball_id AS node, ball_id AS other FROM balls UNION SELECT r.node, e.other FROM reach r JOIN both_ways e ON r.other = e.node),
comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
per_unit AS (SELECT unit, count(*) AS k FROM member GROUP BY unit)"""
)
W = f"WITH RECURSIVE {COVER} "


def canonical(spark, d):
    """(points, balls, membership) of the cover in id order."""
    p = points(spark, d).persist()
    return p, *cover.build_cover(p, AXES, EPS)


@R.add("i1_build_cover", W + "SELECT ball_id, landmark, count(*) AS ball_size FROM member GROUP BY ALL")
def i1(spark, d):
    _, _, m = canonical(spark, d)
    return m.groupBy("ball_id", "landmark").agg(F.count("*").alias("ball_size"))


@R.add("i2_membership", W + "SELECT ball_id, unit FROM member")
def _(spark, d):
    return canonical(spark, d)[2].select("ball_id", "unit")


@R.add("i3_landmarks", W + "SELECT ball_id, landmark FROM balls")
def _(spark, d):
    return canonical(spark, d)[1].select("ball_id", "landmark")


@R.add("i4_balls", W + "SELECT ball_id, count(*) AS ball_size FROM member GROUP BY ball_id")
def _(spark, d):
    return cover.sizes(canonical(spark, d)[2])


@R.add("i5_overlap_edges", W + "SELECT a, b, strength FROM edge")
def _(spark, d):
    return cover.edges(canonical(spark, d)[2])


@R.add("i6_ball_means", W + "SELECT ball_id, round(avg(a1), 6) AS a1, round(avg(urgent), 6) AS urgent FROM member JOIN points ON unit = id GROUP BY ball_id")
def _(spark, d):
    p, _, m = canonical(spark, d)
    return rounded(cover.ball_means(m, p, "id", ["a1", "urgent"]))


@R.add("i7_components", W + "SELECT node, component FROM comp")
def _(spark, d):
    _, b, m = canonical(spark, d)
    return graph.components(b.select(F.col("ball_id").alias("node")), cover.edges(m))


@R.add("i8_component_tables", W + "SELECT component, count(DISTINCT node) AS n_balls, count(DISTINCT unit) AS n_units, count(DISTINCT node) = 1 AS isolated, (SELECT string_agg(node, ',' ORDER BY node) FROM comp d WHERE d.component = comp.component) AS balls FROM comp JOIN member ON node = ball_id GROUP BY component")
def _(spark, d):
    _, b, m = canonical(spark, d)
    return profile.component_table(b, m, cover.edges(m))


SIZE = "s AS (SELECT ball_id, count(*) AS size FROM member GROUP BY ball_id)"


@R.add(
    "i9_topology_summary",
    f"""WITH RECURSIVE {COVER}, {SIZE}, p AS (SELECT size / sum(size) OVER () AS p FROM s) SELECT (SELECT count(*) FROM balls) AS n_balls, (SELECT count(*) FROM edge) AS n_edges, (SELECT count(DISTINCT component) FROM comp) AS n_components,
(SELECT count(*) FROM per_unit) AS n_units, (SELECT round(avg((k > 1)::INT), 6) FROM per_unit) AS share_multicovered, min(size) AS min_size, median(size) AS median_size, round(avg(size), 6) AS mean_size, max(size) AS max_size, (SELECT round(exp(-sum(p * ln(p))), 6) FROM p) AS effective_balls FROM s""",
)
def _(spark, d):
    _, b, m = canonical(spark, d)
    return rounded(profile.topology_summary(b, m, cover.edges(m))).select("n_balls", "n_edges", "n_components", "n_units", "share_multicovered", "min_size", "median_size", "mean_size", "max_size", "effective_balls")


@R.add("i10_overlap_tables", W + "SELECT unit, count(*) AS n_balls, string_agg(ball_id, ',' ORDER BY ball_id) AS balls, count(*) > 1 AS multicovered FROM member GROUP BY unit")
def _(spark, d):
    return profile.overlap_units(canonical(spark, d)[2])


@R.add("i10_overlap_frequency", W + "SELECT k AS n_balls, count(*) AS n_units, round(count(*) / (SELECT count(*) FROM per_unit), 6) AS share FROM per_unit GROUP BY k")
def _(spark, d):
    return rounded(profile.overlap_frequency(canonical(spark, d)[2]))


LONG = "l AS (SELECT id, unnest(['a1', 'a2', 'urgent']) AS variable, unnest([a1, a2, urgent]) AS value FROM points), pop AS (SELECT variable, avg(value) AS pm, stddev_samp(value) AS ps FROM l GROUP BY variable)"
PROFILE = f"{LONG}, prof AS (SELECT ball_id, variable, count(*) AS n, count(value) AS n_nonmissing, count(*) - count(value) AS n_missing, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS sd, min(value) AS min, max(value) AS max, (avg(value) - max(pm)) / max(ps) AS diff FROM member JOIN l ON unit = id JOIN pop USING (variable) GROUP BY ball_id, variable)"


@R.add("i11_ball_profile_long", f"WITH RECURSIVE {COVER}, {PROFILE} SELECT ball_id, variable, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(min, 6) AS min, round(max, 6) AS max, round(diff, 6) AS standardised_difference FROM prof WHERE variable <> 'urgent'")
def _(spark, d):
    p, _, m = canonical(spark, d)
    return rounded(profile.ball_profile_long(m, p, "id", ["a1", "a2"]).select("ball_id", "variable", "n", "mean", "sd", "min", "max", "standardised_difference"))


@R.add("i12_ball_profile_missing", f"WITH RECURSIVE {COVER}, {PROFILE} SELECT ball_id, variable, n_nonmissing, n_missing, round(n_nonmissing / n, 6) AS coverage, round(mean, 6) AS mean FROM prof")
def _(spark, d):
    p, _, m = canonical(spark, d)
    rows = profile.ball_profile_long(m, p, "id", ["a1", "a2", "urgent"]).withColumn("coverage", F.col("n_nonmissing") / F.col("n"))
    return rounded(rows.select("ball_id", "variable", "n_nonmissing", "n_missing", "coverage", "mean"))


MIX = "lv AS (SELECT DISTINCT category AS level FROM points), mix AS (SELECT ball_id, level, count(id) AS n, count(id) / sum(count(id)) OVER (PARTITION BY ball_id) AS share FROM (SELECT DISTINCT ball_id FROM member) CROSS JOIN lv LEFT JOIN (SELECT ball_id, category AS level, id FROM member JOIN points ON unit = id) USING (ball_id, level) GROUP BY ball_id, level), modal AS (SELECT ball_id, arg_min(level, (-n, level)) AS modal_level, max(share) AS modal_share, CASE WHEN count(*) > 1 THEN -sum(share * ln(share)) / ln(count(*)) ELSE 0 END AS h FROM mix WHERE n > 0 GROUP BY ball_id)"


@R.add(
    "i13_ball_profile_wide",
    f"""WITH RECURSIVE {COVER}, {SIZE}, {PROFILE}, {MIX} SELECT ball_id, landmark, size AS ball_size, component, (SELECT count(*) FROM both_ways WHERE node = ball_id) AS degree, (SELECT count(*) FROM both_ways WHERE node = ball_id) = 0 AS isolated,
round(x.mean, 6) AS a1_mean, round(x.diff, 6) AS a1_z, round(y.mean, 6) AS a2_mean, round(y.diff, 6) AS a2_z, modal_level FROM balls JOIN s USING (ball_id) JOIN comp ON node = ball_id JOIN prof x USING (ball_id) JOIN prof y USING (ball_id) JOIN modal USING (ball_id) WHERE x.variable = 'a1' AND y.variable = 'a2'""",
)
def _(spark, d):
    p, b, m = canonical(spark, d)
    return rounded(profile.profile_wide(b, m, cover.edges(m), p, "id", ["a1", "a2"], "category")).drop("entropy")


LOCAL = "bm AS (SELECT ball_id, avg(a1) AS a1, avg(urgent) AS urgent, avg(a2) AS a2 FROM member JOIN points ON unit = id GROUP BY ball_id), local AS (SELECT unit, count(*) AS n_balls, avg(a1) AS a1, avg(urgent) AS urgent, avg(a2) AS a2 FROM member JOIN bm USING (ball_id) GROUP BY unit)"


@R.add("i14_local_colour", f"WITH RECURSIVE {COVER}, {LOCAL} SELECT unit, n_balls, round(a1, 6) AS a1 FROM local")
def _(spark, d):
    p, _, m = canonical(spark, d)
    return rounded(cover.local_colour(m, p, "id", ["a1"]))


@R.add("i15_local_colour_missing", f"WITH RECURSIVE {COVER}, {LOCAL} SELECT unit, n_balls, round(urgent, 6) AS urgent FROM local")
def _(spark, d):
    p, _, m = canonical(spark, d)
    return rounded(cover.local_colour(m, p, "id", ["urgent"]))


@R.add("i16_local_colours", f"WITH RECURSIVE {COVER}, {LOCAL} SELECT unit, n_balls, round(a1, 6) AS a1, round(a2, 6) AS a2, round(urgent, 6) AS urgent FROM local")
def _(spark, d):
    p, _, m = canonical(spark, d)
    return rounded(cover.local_colour(m, p, "id", ["a1", "a2", "urgent"]))


@R.add("i17_category_mix", f"WITH RECURSIVE {COVER}, {MIX} SELECT ball_id, level, n, round(share, 6) AS share FROM mix")
def _(spark, d):
    p, _, m = canonical(spark, d)
    return rounded(profile.category_mix(m, p, "id", "category"))


@R.add("i17_mix_summary", f"WITH RECURSIVE {COVER}, {MIX} SELECT ball_id, modal_level, round(modal_share, 6) AS modal_share, round(h, 6) AS entropy FROM modal")
def _(spark, d):
    p, _, m = canonical(spark, d)
    return rounded(profile.mix_summary(profile.category_mix(m, p, "id", "category"))).drop("n_levels")


@R.add("i18_local_category_probs", f"WITH RECURSIVE {COVER}, {MIX} SELECT unit, level, round(avg(share), 6) AS probability FROM member JOIN mix USING (ball_id) GROUP BY unit, level")
def _(spark, d):
    p, _, m = canonical(spark, d)
    return rounded(profile.local_category_probs(m, profile.category_mix(m, p, "id", "category")))


@R.add(
    "i19_check_cover",
    W
    + """SELECT 'all_covered' AS "check", (SELECT count(*) FROM points WHERE id NOT IN (SELECT unit FROM member)) = 0 AS passed
UNION ALL SELECT 'known_units', (SELECT count(*) FROM member WHERE unit NOT IN (SELECT id FROM points)) = 0
UNION ALL SELECT 'nonempty', (SELECT count(*) FROM balls) > 0
UNION ALL SELECT 'one_landmark', (SELECT count(*) = count(DISTINCT landmark) FROM balls)
UNION ALL SELECT 'landmark_inside', (SELECT count(*) FROM balls b WHERE NOT EXISTS (SELECT 1 FROM member m WHERE m.ball_id = b.ball_id AND m.unit = b.landmark)) = 0""",
)
def _(spark, d):
    return cover.check_cover(*canonical(spark, d))


@R.add(
    "i20_fingerprint",
    f"""WITH RECURSIVE {COVER}, h AS (SELECT ball_id, landmark, count(*) AS n, sum(('0x' || substr(sha256(unit::VARCHAR), 1, 15))::HUGEINT) AS h FROM member GROUP BY ALL), t AS (SELECT 'BALL|' || ball_id || '|' || landmark || '|' || n || '|' || h AS line FROM h UNION ALL SELECT 'EDGE|' || a || '|' || b || '|' || strength FROM edge)
SELECT sha256(count(*) || '|' || sum(('0x' || substr(sha256(line), 1, 15))::HUGEINT)) AS fingerprint FROM t""",
)
def _(spark, d):
    _, b, m = canonical(spark, d)
    return cover.fingerprint(b, m, cover.edges(m))


@R.add("i21_covers_equal", W + "SELECT landmark, count(*) AS n_both, 0::BIGINT AS only_a, 0::BIGINT AS only_b FROM member GROUP BY landmark")
def _(spark, d):
    p, _, m = canonical(spark, d)
    return cover.compare_covers(m, cover.build_cover(p.repartition(5, "category"), AXES, EPS, head=7)[1])


@R.add("i22_order_key", f"WITH {POINTS} SELECT id, row_number() OVER (ORDER BY md5(id || ':' || '20261816'), id) AS place FROM points")
def _(spark, d):
    from coverscope.operators import bins

    keyed = points(spark, d).select("id", F.concat_ws("|", cover.order_key("id", 20260807 + 1009), F.lpad(F.col("id").cast("string"), 20, "0")).alias("k"))
    return bins.canonical_order(keyed, "k", "place").select("id", "place")


@R.add("i44_graph_context", W + "SELECT ball_id AS node, count(other) AS degree, coalesce(sum(strength), 0)::BIGINT AS weighted_degree, coalesce(arg_min(other, (-strength, other)), 0) AS strongest, coalesce(string_agg(other, ',' ORDER BY other), '') AS neighbours FROM balls LEFT JOIN both_ways ON node = ball_id GROUP BY ball_id")
def _(spark, d):
    _, b, m = canonical(spark, d)
    return graph.context(b.select(F.col("ball_id").alias("node")), cover.edges(m)).fillna({"strongest": 0, "neighbours": ""})


@R.add("i45_membership_context", W + "SELECT ball_id, round(avg(k), 6) AS mean_multiplicity, median(k) AS median_multiplicity, round(avg((k > 1)::INT), 6) AS share_multicovered FROM member JOIN per_unit USING (unit) GROUP BY ball_id")
def _(spark, d):
    return rounded(profile.membership_context(canonical(spark, d)[2]))


@R.add("i46_cluster_alignment", f"WITH RECURSIVE {COVER}, {MIX} SELECT ball_id, modal_level, round(modal_share, 6) AS modal_share, modal_share < 0.5 AS mixed FROM modal")
def _(spark, d):
    p, _, m = canonical(spark, d)
    return rounded(profile.mix_summary(profile.category_mix(m, p, "id", "category")).select("ball_id", "modal_level", "modal_share", (F.col("modal_share") < 0.5).alias("mixed")))


@R.add("i61_profile_matrix", f"WITH RECURSIVE {COVER}, {PROFILE} SELECT ball_id, " + ", ".join(f"round(max(diff) FILTER (variable = '{v}'), 6) AS {v}" for v in ("a1", "a2", "urgent")) + " FROM prof GROUP BY ball_id")
def _(spark, d):
    p, _, m = canonical(spark, d)
    return rounded(profile.profile_matrix(profile.ball_profile_long(m, p, "id", ["a1", "a2", "urgent"]), ["a1", "a2", "urgent"]), "a1", "a2", "urgent")


@R.add("e5_representative", W + ", c AS (SELECT ball_id, avg(z1) AS m1, avg(z2) AS m2, avg(z3) AS m3 FROM member JOIN points ON unit = id GROUP BY ball_id) SELECT ball_id, arg_min(unit, (round((z1-m1)*(z1-m1) + (z2-m2)*(z2-m2) + (z3-m3)*(z3-m3), 9), unit)) AS medoid FROM member JOIN points ON unit = id JOIN c USING (ball_id) GROUP BY ball_id")
def _(spark, d):
    p, _, m = canonical(spark, d)
    return profile.representative(m, p, "id", AXES)


@R.add("d13_resolution_metrics", f"WITH RECURSIVE {COVER}, {SIZE}, p AS (SELECT size, size / sum(size) OVER () AS p FROM s) SELECT count(*) AS n_balls, round(exp(-sum(p * ln(p))), 6) AS effective_balls, round(-sum(p * ln(p)) / ln(count(*)), 6) AS normalised_entropy, round(max(size) / (SELECT count(*) FROM points), 6) AS largest_share FROM p")
def _(spark, d):
    p, _, m = canonical(spark, d)
    return rounded(profile.resolution_metrics(cover.sizes(m), p.agg(F.count("*").alias("n")))).select("n_balls", "effective_balls", "normalised_entropy", "largest_share")


@R.add("c20_comembership", W + "SELECT DISTINCT m.unit AS id1, n.unit AS id2 FROM member m JOIN member n ON m.ball_id = n.ball_id AND m.unit < n.unit WHERE m.unit % 20 = 0")
def _(spark, d):
    return comembership(canonical(spark, d)[2], F.col("id1") % 20 == 0)


#: Units of a pack at most (an eighth in one of focal units); units that a side of a meeting has room for, in a ball of up to MOST parts; beyond it a part has up to LARGEST.
PACK, MEETING, MOST, LARGEST = 1024, 4096, 8, 40_000
PAIRS = 4_000_000  # that a task has room for


def packs(rows, keys, unit, size, name):
    """keys, balls and name (up to size successive units in the same balls) of rows (keys, balls, unit)."""
    ordered = bins.canonical_order(rows, [*map(F.col, keys), F.col("balls"), F.col(unit)], "_at")
    starts = ordered.groupBy(*keys, "balls").agg(F.min("_at").alias("_start"))
    numbered = ordered.join(starts, [*keys, "balls"]).withColumn("_pack", F.floor((F.col("_at") - F.col("_start")) / size))
    return scratch.cut(numbered.groupBy(*keys, "balls", "_pack").agg(F.sort_array(F.collect_list(unit)).alias(name)).drop("_pack"))


def comembership(membership, focal, keys=(), pack=PACK, meeting=MEETING):
    """Pairs of units that share a ball, id1 < id2 and id1 focal.

    Units that are in the same balls are alike, so they go into packs in the order of their ids, and packs go to each of their balls.
    A ball's packs are dealt into parts, parts of focal units meet parts of all, and two packs give their pairs in the least ball
    that they share. So what is shuffled follows the membership: a part goes out MOST times, or more where a ball has over
    MOST * LARGEST units. Pairs are unfolded where packs met and are never shuffled. As there are so many, their order matters to
    files of columns: the ids of a focal pack come again and again, each time with one other id, and a task has few different ones."""
    keys = list(keys)
    alike = membership.groupBy(*keys, "unit").agg(F.sort_array(F.collect_set("ball_id")).alias("balls"))
    all_ = packs(alike, keys, "unit", pack, "ids2")
    focals = packs(all_.select(*keys, "balls", F.explode("ids2").alias("id1")).where(focal), keys, "id1", max(1, pack // 8), "ids1")
    n = F.sum(F.size("ids"))
    parts = F.greatest(F.least(F.ceil(n / meeting), F.lit(MOST)), F.ceil(n / LARGEST)).cast("int")
    sides = [x.withColumn("ball_id", F.explode("balls")) for x in (focals, all_)]
    sizes = [x.withColumnRenamed(ids, "ids").groupBy(*keys, "ball_id").agg(parts.alias(of), n.alias(f"n_{of}")) for x, ids, of in zip(sides, ("ids1", "ids2"), ("rows", "columns"), strict=True)]
    room = scratch.cut(sizes[0].join(sizes[1], [*keys, "ball_id"]))
    cells, pairs = room.agg(F.sum(F.col("rows") * F.col("columns")), F.sum(F.col("n_rows").cast("double") * F.col("n_columns"))).first()
    # the pairs tell how many partitions: small tables give large results, which Spark can't see when it joins partitions by size
    n = max(1, min(2 * (cells or 0), int((pairs or 0) // PAIRS) + 1))
    room = room.select(*keys, "ball_id", "rows", "columns")
    own, every = lambda x, of: F.pmod(F.xxhash64("balls", x), F.col(of)).cast("int"), lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    a, b = (x.join(room, [*keys, "ball_id"]) for x in sides)
    a = a.select(*keys, "ball_id", own("ids1", "rows").alias("row"), every("columns").alias("column"), "balls", "ids1")
    b = b.select(*keys, "ball_id", every("rows").alias("row"), own("ids2", "columns").alias("column"), F.col("balls").alias("others"), "ids2")
    at = [*keys, "ball_id", "row", "column"]
    a, b = (x.repartition(n, *at) for x in (a, b))
    met = a.join(b.hint("merge"), at).where((F.get("ids1", F.lit(0)) < F.get("ids2", F.size("ids2") - 1)) & (F.array_min(F.array_intersect("balls", "others")) == F.col("ball_id")))
    later = F.filter("ids2", lambda x: x > F.get("ids1", F.lit(0)))  # no part of generated code, which would hold all pairs of a row at once
    return met.select(*keys, F.explode(later).alias("id2"), "ids1").select(*keys, F.explode("ids1").alias("id1"), "id2").where("id1 < id2")
