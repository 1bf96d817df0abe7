"""Queries on aggregations, binning, ranking, sorts and sets (D to G)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from coverscope.functions import columns as C
from coverscope.operators import bins, scale, stats
from coverscope.plans.frames import AXES, POINTS, UNITS, points, table, units
from coverscope.plans.registry import Registry

R = Registry()


def rounded(df, *columns, digits=6):
    """df with doubles rounded, the named ones or all."""
    names = columns or [f.name for f in df.schema if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(c, digits) for c in names})


LONG = "l AS (SELECT unnest(['a1', 'a2', 'a3']) AS variable, unnest([a1, a2, a3]) AS value FROM units)"
STATS = "count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS p25, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS p75, round(max(value), 6) AS max"
MOMENT = "avg((value - m) ** 3) / avg((value - m) ** 2) ** 1.5"


@R.add("d1_describe_long", f"WITH {UNITS}, {LONG} SELECT variable, {STATS} FROM l GROUP BY variable")
def _(spark, d):
    return rounded(stats.describe_long(units(spark, d), ["a1", "a2", "a3"]))


@R.add(
    "d2_summary_table",
    f"""WITH {UNITS}, {LONG}, c AS (SELECT *, avg(value) OVER (PARTITION BY variable) AS m FROM l)
SELECT variable, {STATS.replace(', 6)', ', 3)')}, round({MOMENT}, 3) AS skewness, round(kurtosis_pop(value), 3) AS kurtosis FROM c GROUP BY variable""",
)
def _(spark, d):
    return stats.summary_table(units(spark, d), ["a1", "a2", "a3"], 3)


@R.add("d3_weighted_mean", "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem GROUP BY l_returnflag")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(stats.weighted_mean(F.col("l_discount"), F.col("l_quantity")), 6).alias("mean"))


@R.add("d4_group_mean", f"WITH {UNITS} SELECT class, round(avg(urgent), 6) AS mean, count(DISTINCT category) AS n_categories, string_agg(DISTINCT category, ', ' ORDER BY category) AS categories FROM units GROUP BY class")
def _(spark, d):
    return units(spark, d).groupBy("class").agg(F.round(F.avg("urgent"), 6).alias("mean"), F.count_distinct("category").alias("n_categories"), F.array_join(F.array_sort(F.collect_set("category")), ", ").alias("categories"))


@R.add("d5_count_by_key", "SELECT p_partkey, count(l_orderkey) AS n, count(l_orderkey) > 0 AS present FROM part LEFT JOIN lineitem ON p_partkey = l_partkey AND l_returnflag = 'R' GROUP BY p_partkey")
def _(spark, d):
    counts = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "part").select("p_partkey").join(counts, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("present"))


@R.add("d6_frequency", "SELECT l_returnflag AS level, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS share FROM lineitem GROUP BY l_returnflag")
def _(spark, d):
    return rounded(stats.frequency(table(spark, d, "lineitem"), "l_returnflag"))


@R.add("d7_crosstab", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS share FROM lineitem GROUP BY l_returnflag, l_linestatus")
def _(spark, d):
    return rounded(stats.crosstab_long(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus"))


RANK = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@R.add(
    "d8_safe_corr",
    f"""WITH {UNITS}, r AS (SELECT a2, n_orders, {RANK('a2')} AS r2, {RANK('n_orders')} AS rn FROM units)
SELECT round(corr(a2, n_orders), 6) AS pearson, round(corr(r2, rn), 6) AS spearman FROM r""",
)
def _(spark, d):
    u = units(spark, d)
    return rounded(u.agg(stats.correlation(F.col("a2"), F.col("n_orders")).alias("pearson")).crossJoin(stats.spearman(u, "a2", "n_orders", "spearman")))


def _pair(a, b, pearson):
    value = f"corr({a}, {b})" if pearson else f"corr(r_{a}, r_{b})"
    return f"SELECT '{a}' AS row, '{b}' AS column, round({value}, 3) AS value FROM r"


@R.add(
    "d9_corr_matrix",
    f"WITH {UNITS}, r AS (SELECT *, " + ", ".join(f"{RANK(c)} AS r_{c}" for c in ("a1", "a2", "a3")) + " FROM units) " + " UNION ALL ".join(_pair(a, b, a > b) for a in ("a1", "a2", "a3") for b in ("a1", "a2", "a3") if a != b),
)
def _(spark, d):
    return stats.corr_matrix(units(spark, d), ["a1", "a2", "a3"])


@R.add("d10_corr_against", f"WITH {UNITS} SELECT unnest(['a2', 'a3', 'n_orders']) AS variable, unnest([round(corr(a1, a2), 6), round(corr(a1, a3), 6), round(corr(a1, n_orders), 6)]) AS pearson FROM units")
def _(spark, d):
    return rounded(stats.corr_against(units(spark, d).withColumn("n_orders", F.col("n_orders").cast("double")), "a1", ["a2", "a3", "n_orders"]))


@R.add(
    "d11_cramers_v",
    """WITH c AS (SELECT o_orderpriority AS a, c_mktsegment AS b, count(*) AS o FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
ra AS (SELECT a, sum(o) AS r FROM c GROUP BY a), cb AS (SELECT b, sum(o) AS c FROM c GROUP BY b), t AS (SELECT sum(o) AS n FROM c),
x AS (SELECT n, sum((coalesce(o, 0) - r * c.c / n) ** 2 / (r * c.c / n)) AS chi2, least(count(DISTINCT ra.a), count(DISTINCT c.b)) AS k FROM ra CROSS JOIN cb AS c CROSS JOIN t LEFT JOIN c AS o ON o.a = ra.a AND o.b = c.b GROUP BY n)
SELECT n::BIGINT AS n, round(chi2, 6) AS chi2, round(sqrt(chi2 / (n * (k - 1))), 6) AS v FROM x""",
)
def _(spark, d):
    both = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rounded(stats.cramers_v(both, "o_orderpriority", "c_mktsegment"))


@R.add(
    "d12_entropy",
    f"WITH {UNITS}, c AS (SELECT class, category, count(*) AS n FROM units GROUP BY ALL), p AS (SELECT class, n / sum(n) OVER (PARTITION BY class) AS p FROM c) SELECT class, count(*) AS levels, round(-sum(p * ln(p)) / ln(count(*)), 6) AS entropy FROM p GROUP BY class",
)
def _(spark, d):
    return rounded(stats.entropy(units(spark, d), ["class"], "category"))


@R.add(
    "d14_mode_by",
    """WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS k, sum(n) OVER (PARTITION BY o_custkey) AS t FROM c)
SELECT o_custkey, o_orderpriority AS mode, n, round(n / t, 6) AS share FROM r WHERE k = 1""",
)
def _(spark, d):
    return rounded(stats.mode_by(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority"))


@R.add(
    "d15_total_variation",
    f"""WITH {UNITS}, m AS (SELECT class, category, count(*) / sum(count(*)) OVER (PARTITION BY class) AS p FROM units GROUP BY class, category), g AS (SELECT DISTINCT class FROM m), lv AS (SELECT DISTINCT category FROM m)
SELECT x.class AS a, y.class AS b, round(0.5 * sum(abs(coalesce(p.p, 0) - coalesce(q.p, 0))), 6) AS total_variation FROM g x JOIN g y ON x.class < y.class CROSS JOIN lv
LEFT JOIN m p ON p.class = x.class AND p.category = lv.category LEFT JOIN m q ON q.class = y.class AND q.category = lv.category GROUP BY ALL""",
)
def _(spark, d):
    return rounded(stats.total_variation(stats.crosstab_long(units(spark, d), "class", "category"), "class", "category", "share"))


@R.add("d16_quantile_type7", f"WITH {UNITS} SELECT class, round(quantile_cont(a2, 0.1), 6) AS q10, round(quantile_cont(a2, 0.9), 6) AS q90 FROM units GROUP BY class")
def _(spark, d):
    return rounded(units(spark, d).groupBy("class").agg(F.percentile("a2", 0.1).alias("q10"), F.percentile("a2", 0.9).alias("q90")))


@R.add(
    "d17_quantile_type8",
    f"""WITH {UNITS}, l AS (SELECT class, list(a2 ORDER BY a2) AS v, count(*) AS n FROM units GROUP BY class), h AS (SELECT *, (n + 1/3) * 0.1 + 1/3 AS h FROM l)
SELECT class, round(v[floor(h)::INT] + (h - floor(h)) * (v[floor(h)::INT + 1] - v[floor(h)::INT]), 6) AS quantile FROM h""",
)
def _(spark, d):
    return rounded(stats.quantile_type8(units(spark, d), "a2", 0.1, ["class"]))


@R.add(
    "d18_outliers_mad",
    f"""WITH {UNITS}, l AS (SELECT id, unnest(['a1', 'a2', 'urgent']) AS variable, unnest([a1, a2, urgent]) AS value FROM units), m AS (SELECT variable, median(value) AS centre FROM l GROUP BY variable),
o AS (SELECT * FROM l JOIN m USING (variable)), s AS (SELECT variable, 1.4826 * median(abs(value - centre)) AS scale FROM o GROUP BY variable)
SELECT id, variable, round(abs(value - centre) / scale, 6) AS score, coalesce(abs(value - centre) / scale >= 2, false) AS flag, CASE WHEN value IS NULL THEN 'missing_or_non_finite' WHEN scale = 0 THEN 'zero_robust_scale' ELSE 'analysed' END AS status FROM o JOIN s USING (variable)""",
)
def _(spark, d):
    return rounded(stats.outliers(units(spark, d), "id", ["a1", "a2", "urgent"], "mad", 2.0).select("id", "variable", "score", "flag", "status"))


IQR = "l AS (SELECT id, unnest(['a1', 'a2', 'urgent']) AS variable, unnest([a1, a2, urgent]) AS value FROM units), q AS (SELECT variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM l GROUP BY variable), f AS (SELECT *, coalesce(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1), false) AS flag FROM l JOIN q USING (variable))"


@R.add("d18_outliers_iqr", f"WITH {UNITS}, {IQR} SELECT id, variable, round(q1 - 1.5 * (q3 - q1), 6) AS lower, round(q3 + 1.5 * (q3 - q1), 6) AS upper, flag FROM f")
def _(spark, d):
    return rounded(stats.outliers(units(spark, d), "id", ["a1", "a2", "urgent"], "iqr", 1.5).select("id", "variable", "lower", "upper", "flag"))


@R.add("d19_outlier_summary", f"WITH {UNITS}, {IQR} SELECT id, count(*) AS n_flags, string_agg(variable, ', ' ORDER BY variable) AS variables FROM f WHERE flag GROUP BY id")
def _(spark, d):
    return stats.outlier_units(stats.outliers(units(spark, d), "id", ["a1", "a2", "urgent"], "iqr", 1.5), "id").select("id", "n_flags", "variables")


@R.add("d20_kmeans_benchmark")
def _(spark, d):
    return stats.kmeans_benchmark(points(spark, d), "id", ["z1", "z2", "z3"], range(2, 9))


@R.add("d21_wss_table")
def _(spark, d):
    return stats.kmeans_benchmark(points(spark, d), "id", ["z1", "z2", "z3"], range(1, 7)).select("k", "within_ss")


@R.add("d20_kmeans_profiles")
def _(spark, d):
    p = points(spark, d)
    found = stats.kmeans_clusters(p, "id", AXES, range(2, 9))
    return stats.cluster_profiles(found, p, "id", AXES)


FIRST = "f AS (SELECT id, z1, z2, z3, row_number() OVER (ORDER BY id) AS place FROM points), ce AS (SELECT k::INT AS k, place - 1 AS cluster, z1, z2, z3 FROM f, (VALUES (2), (3), (4)) v(k) WHERE place <= k)"


@R.add("d20_lloyd_step", f"WITH {POINTS}, {FIRST}, nr AS (SELECT p.id, p.z1, p.z2, p.z3, ce.k, arg_min(cluster, ((p.z1-ce.z1)**2 + (p.z2-ce.z2)**2 + (p.z3-ce.z3)**2, cluster)) AS cluster, min((p.z1-ce.z1)**2 + (p.z2-ce.z2)**2 + (p.z3-ce.z3)**2) AS d FROM points p, ce GROUP BY ALL) SELECT k, cluster::INT AS cluster, count(*) AS n, round(sum(d), 6) AS within_ss, round(avg(z1), 6) AS z1, round(avg(z2), 6) AS z2, round(avg(z3), 6) AS z3 FROM nr GROUP BY k, cluster")
def _(spark, d):
    p = points(spark, d)
    first = np.array([[r[a] for a in AXES] for r in p.orderBy("id").limit(4).collect()])
    step = stats.lloyd_step(p, AXES, {k: first[:k] for k in (2, 3, 4)}).where("n > 0")
    return rounded(step.select((F.col("config") + 2).alias("k"), "cluster", "n", "within_ss", *[(F.col(a) / F.col("n")).alias(a) for a in AXES]))


FIT = "SELECT regr_count(z1, m) AS n, regr_slope(z1, m) AS b, regr_intercept(z1, m) AS a, regr_r2(z1, m) AS r2, regr_sxx(z1, m) AS sxx, regr_syy(z1, m) * (1 - regr_r2(z1, m)) AS rss, avg(m) AS mx FROM (SELECT z1, (category = 'MACHINERY')::INT::DOUBLE AS m FROM points)"


@R.add(
    "d22_ols_factor",
    f"""WITH {POINTS}, f AS ({FIT}), t AS (SELECT 'intercept' AS term, a AS c, sqrt(rss / (n - 2) * (1 / n + mx * mx / sxx)) AS se, f.* FROM f UNION ALL SELECT 'machinery', b, sqrt(rss / (n - 2) / sxx), f.* FROM f)
SELECT term, round(c, 6) AS coefficient, round(se, 6) AS std_error, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) AS adj_r2, round(n * (ln(2 * pi() * rss / n) + 1) + 6, 4) AS aic FROM t""",
)
def _(spark, d):
    fit = stats.ols(points(spark, d), "z1", {"machinery": (F.col("category") == "MACHINERY").cast("int")})
    return rounded(fit, "coefficient", "std_error", "r2", "adj_r2").withColumn("aic", F.round("aic", 4))


@R.add("d22_ols")
def _(spark, d):
    u = points(spark, d)
    factor = stats.ols(u, "z1", {"machinery": (F.col("category") == "MACHINERY").cast("int")}).withColumn("model", F.lit("factor"))
    full = stats.ols(u, "z1", {"machinery": (F.col("category") == "MACHINERY").cast("int"), "z2": F.col("z2"), "z3": F.col("z3"), "z2_z3": F.col("z2") * F.col("z3")}).withColumn("model", F.lit("full"))
    return factor.unionByName(full)


@R.add("d23_compare_vectors", f"WITH {POINTS} SELECT count(*) AS n, round(sqrt(avg((z1 - z2) ** 2)), 6) AS rmse, round(avg(abs(z1 - z2)), 6) AS mae, round(corr(z1, z2), 6) AS pearson FROM points")
def _(spark, d):
    return rounded(stats.compare_vectors(points(spark, d), "z1", "z2"))


@R.add(
    "d24_duplicate_column_audit",
    """SELECT 'l_discount' AS a, 'l_tax' AS b, count(*) AS n_complete, count(*) FILTER (abs(l_discount - l_tax) < 1e-12) AS n_equal, round(corr(l_discount, l_tax), 6) AS pearson, round(count(*) FILTER (abs(l_discount - l_tax) < 1e-12) / count(*), 6) AS share_equal FROM lineitem
UNION ALL SELECT 'l_quantity', 'l_quantity', count(*), count(*), 1.0, 1.0 FROM lineitem""",
)
def _(spark, d):
    return rounded(stats.duplicate_column_audit(table(spark, d, "lineitem"), [("l_discount", "l_tax"), ("l_quantity", "l_quantity")]))


@R.add(
    "d25_reconcile",
    "WITH r AS (SELECT l_returnflag AS level, round(sum(l_tax * l_quantity) / sum(l_quantity), 2) AS rebuilt, round(avg(l_tax), 2) AS published FROM lineitem GROUP BY ALL) SELECT level, rebuilt, published, abs(rebuilt - published) < 0.005 AS agrees FROM r",
)
def _(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("level"))
    rebuilt = rows.agg(F.round(stats.weighted_mean(F.col("l_tax"), F.col("l_quantity")), 2).alias("rebuilt"))
    return rebuilt.join(rows.agg(F.round(F.avg("l_tax"), 2).alias("published")), "level").withColumn("agrees", F.abs(F.col("rebuilt") - F.col("published")) < 0.005)


@R.add(
    "d26_decision_ledger",
    "WITH e AS (SELECT count(*) = count(DISTINCT o_orderkey) AS unique_keys, min(o_totalprice) > 0 AS positive, max(o_totalprice) < 1e9 AS bounded FROM orders) SELECT unnest(['unique_keys', 'positive', 'bounded']) AS check_name, unnest([CASE WHEN unique_keys THEN 'KEEP' ELSE 'REVIEW' END, CASE WHEN positive THEN 'KEEP' ELSE 'REVIEW' END, CASE WHEN bounded THEN 'KEEP' ELSE 'REVIEW' END]) AS decision FROM e",
)
def _(spark, d):
    one = table(spark, d, "orders").agg((F.count("*") == F.count_distinct("o_orderkey")).alias("unique_keys"), (F.min("o_totalprice") > 0).alias("positive"), (F.max("o_totalprice") < 1e9).alias("bounded"))
    return one.unpivot([], one.columns, "check_name", "ok").select("check_name", F.when(F.col("ok"), "KEEP").otherwise("REVIEW").alias("decision"))


BREAKS = "b AS (SELECT list_distinct(quantile_cont(a2, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])) AS br FROM units), binned AS (SELECT units.*, least(1 + len(list_filter(list_sort(br)[2:], lambda q: a2 > q)), len(br) - 1) AS bin FROM units, b)"


@R.add("e1_quantile_bins", f"WITH {UNITS}, {BREAKS} SELECT id, bin::INT AS bin FROM binned")
def _(spark, d):
    return bins.quantile_bins(units(spark, d), "a2").select("id", "bin")


@R.add(
    "d27_dispersion_ratio",
    f"WITH {UNITS}, {BREAKS}, i AS (SELECT avg(s) AS w FROM (SELECT stddev_samp(a3) AS s FROM binned GROUP BY bin)) SELECT 'a3' AS variable, round(w, 6) AS within_sd, round((SELECT stddev_samp(a3) FROM units), 6) AS overall_sd, round(w / (SELECT stddev_samp(a3) FROM units), 6) AS ratio FROM i",
)
def _(spark, d):
    return rounded(stats.dispersion_ratio(bins.quantile_bins(units(spark, d), "a2"), "bin", ["a3"]))


@R.add("d28_decile_profile", f"WITH {UNITS}, {BREAKS} SELECT bin::INT AS bin, count(*) AS n, min(a2) AS lo, max(a2) AS hi, round(quantile_cont(a1, 0.25), 6) AS p25, round(median(a1), 6) AS median, round(quantile_cont(a1, 0.75), 6) AS p75 FROM binned GROUP BY bin")
def _(spark, d):
    b = bins.quantile_bins(units(spark, d), "a2").groupBy("bin")
    return rounded(b.agg(F.count("*").alias("n"), F.min("a2").alias("lo"), F.max("a2").alias("hi"), F.percentile("a1", 0.25).alias("p25"), F.percentile("a1", 0.5).alias("median"), F.percentile("a1", 0.75).alias("p75")))


@R.add(
    "d29_discordance",
    f"""WITH {UNITS} SELECT t::DOUBLE AS threshold, count(*) FILTER (class = 1) AS n_flagged, count(*) FILTER (class = 1 AND a2 > t) AS n_flagged_far, count(*) FILTER (class <> 1) AS n_other, count(*) FILTER (class <> 1 AND a2 <= t) AS n_other_near,
round(count(*) FILTER (class = 1 AND a2 > t) / count(*) FILTER (class = 1), 6) AS share_flagged_far, round(count(*) FILTER (class <> 1 AND a2 <= t) / count(*) FILTER (class <> 1), 6) AS share_other_near FROM units, (VALUES (0), (2500), (5000)) v(t) GROUP BY t""",
)
def _(spark, d):
    return rounded(stats.discordance(units(spark, d).withColumn("f", F.col("class") == 1), "f", "a2", [0, 2500, 5000]))


@R.add(
    "d30_flag_summary",
    f"""WITH {UNITS} SELECT 'rich' AS flag, count(*) FILTER (a2 > 5000) AS n, round(avg(a1) FILTER (a2 > 5000), 6) AS mean_a1, round(avg(a3) FILTER (a2 > 5000), 6) AS mean_a3 FROM units
UNION ALL SELECT 'none', count(*) FILTER (a2 > 1e9), avg(a1) FILTER (a2 > 1e9), avg(a3) FILTER (a2 > 1e9) FROM units""",
)
def _(spark, d):
    return rounded(stats.flag_summary(units(spark, d).withColumns({"rich": F.col("a2") > 5000, "none": F.col("a2") > 1e9}), ["rich", "none"], ["a1", "a3"]))


@R.add(
    "d31_weighted_total",
    f"WITH {UNITS}, r AS (SELECT class::VARCHAR AS class, count(*) AS n, avg(a2) AS a2 FROM units GROUP BY class) SELECT class, n::BIGINT AS n, round(a2, 6) AS a2 FROM r UNION ALL SELECT 'ALL', sum(n)::BIGINT, round(sum(a2 * n) / sum(n), 6) FROM r",
)
def _(spark, d):
    rows = units(spark, d).groupBy("class").agg(F.count("*").alias("n"), F.avg("a2").alias("a2"))
    return rounded(stats.with_weighted_total(rows, "class", "n", ["a2"]))


@R.add("d32_partitions_equivalent", "WITH p AS (SELECT DISTINCT c_mktsegment AS a, md5(c_mktsegment) AS b FROM customer) SELECT count(DISTINCT a) = count(*) AND count(DISTINCT b) = count(*) AS equivalent, count(*) AS n_pairs FROM p")
def _(spark, d):
    return stats.partitions_equivalent(table(spark, d, "customer").withColumn("other", F.md5("c_mktsegment")), "c_mktsegment", "other")


@R.add("e2_top_n", "SELECT o_custkey, o_orderkey, k::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def _(spark, d):
    return bins.top_n(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@R.add("e3_nearest_row", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY abs(o_totalprice - 100000), o_totalprice) AS k FROM orders) WHERE k = 1")
def _(spark, d):
    return bins.nearest_row(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", 100000).select("o_custkey", "o_orderkey")


@R.add("e4_first_per_key", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def _(spark, d):
    return bins.top_n(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderkey")], 1).select("o_custkey", "o_orderkey")


@R.add("e7_canonical_order", "SELECT c_name, row_number() OVER (ORDER BY c_name) AS point_index FROM customer")
def _(spark, d):
    return bins.canonical_order(table(spark, d, "customer").select("c_name"), "c_name")


@R.add("e8_average_rank", f"WITH {UNITS} SELECT id, ({RANK('n_orders')})::DOUBLE AS avg_rank FROM units")
def _(spark, d):
    return scale.average_rank(units(spark, d).select("id", "n_orders"), "n_orders", "avg_rank").select("id", F.col("avg_rank").cast("double"))


CURVE = "c AS (SELECT l_quantity AS x, sum(count(*)) OVER (ORDER BY l_quantity) / (SELECT count(*) FROM lineitem) AS y FROM lineitem GROUP BY l_quantity)"


def curve(spark, d):
    from pyspark.sql import Window

    n = table(spark, d, "lineitem").groupBy(F.col("l_quantity").alias("x")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    return n.crossJoin(F.broadcast(total)).select("x", (F.sum("n").over(Window.orderBy("x")) / F.col("t")).alias("y"))  # a row for each quantity


@R.add(
    "e10_first_crossing",
    f"WITH {CURVE}, w AS (SELECT *, lag(x) OVER (ORDER BY x) AS x0, lag(y) OVER (ORDER BY x) AS y0 FROM c), f AS (SELECT * FROM w WHERE y >= 0.5 ORDER BY x LIMIT 1) SELECT round(exp(ln(x0) + (0.5 - y0) / (y - y0) * (ln(x) - ln(x0))), 6) AS crossing, 'LOG_RADIUS_INTERPOLATED' AS status FROM f",
)
def _(spark, d):
    return rounded(bins.first_crossing(curve(spark, d), "x", "y", 0.5))


@R.add("e11_review_rows", f"WITH {CURVE} SELECT x, round(y, 6) AS y, (x - 25)::INT AS \"offset\", CASE WHEN x = 25 THEN 'reference' WHEN x < 25 THEN 'below' ELSE 'above' END AS role FROM c WHERE abs(x - 25) <= 3")
def _(spark, d):
    return rounded(bins.review_rows(curve(spark, d), "x", 25.2, 3), "y")


@R.add("f2_multi_key_sort", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus DESC, o_totalprice > 100000 DESC, o_orderkey) AS place FROM orders")
def _(spark, d):
    keys = [F.desc("o_orderstatus"), F.desc(F.col("o_totalprice") > 100000), F.col("o_orderkey")]
    return bins.canonical_order(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), keys, "place").select("o_orderkey", "place")


@R.add("f3_top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 500")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(500)


@R.add("g1_union_fill", "SELECT n_nationkey AS key, n_name AS name, n_regionkey::DOUBLE AS parent FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region")
def _(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("double").alias("parent"))
    return a.unionByName(table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")), allowMissingColumns=True)


@R.add(
    "g2_set_operations",
    "WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'N') SELECT 'both' AS part, k FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'a_only', k FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'b_only', k FROM (SELECT * FROM b EXCEPT SELECT * FROM a)",
)
def _(spark, d):
    side = lambda v: table(spark, d, "lineitem").where(F.col("l_returnflag") == v).select(F.col("l_orderkey").alias("k"))
    a, b = side("A"), side("N")
    named = lambda n, df: df.select(F.lit(n).alias("part"), "k")
    return named("both", a.intersect(b)).unionByName(named("a_only", a.subtract(b))).unionByName(named("b_only", b.subtract(a)))


@R.add("g3_set_equality", "SELECT count(*) FILTER (c_custkey IS NULL) AS only_right, count(*) FILTER (o_custkey IS NULL) AS only_left FROM customer FULL JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 200000) ON c_custkey = o_custkey")
def _(spark, d):
    right = table(spark, d, "orders").where("o_totalprice > 200000").select("o_custkey").distinct()
    both = table(spark, d, "customer").select("c_custkey").join(right, F.col("c_custkey") == F.col("o_custkey"), "full")
    return both.agg(F.count_if(F.col("c_custkey").isNull()).alias("only_right"), F.count_if(F.col("o_custkey").isNull()).alias("only_left"))


@R.add(
    "g4_jaccard_lists",
    "WITH s AS (SELECT l_orderkey AS k, list(DISTINCT l_partkey) FILTER (l_linestatus = 'F') AS a, list(DISTINCT l_partkey) FILTER (l_quantity > 25) AS b FROM lineitem GROUP BY 1) SELECT k, round(len(list_intersect(coalesce(a, []), coalesce(b, []))) / nullif(len(list_distinct(list_concat(a, b))), 0), 6) AS jaccard FROM s",
)
def _(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set(F.when(F.col("l_linestatus") == "F", F.col("l_partkey"))).alias("a"), F.collect_set(F.when(F.col("l_quantity") > 25, F.col("l_partkey"))).alias("b"))
    return s.select("k", F.round(F.size(F.array_intersect("a", "b")) / F.nullif(F.size(F.array_union("a", "b")), F.lit(0)), 6).alias("jaccard"))


@R.add("g5_distinct_pairs", "SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).distinct()


@R.add("h_zero_overlap_chance", "WITH RECURSIVE n AS (SELECT count(*) - 1 AS m FROM customer), p AS (SELECT 0 AS k, m, 1::DOUBLE AS z FROM n UNION ALL SELECT k + 1, m, NULL FROM p WHERE k < 30) SELECT k, round(list_product(list_transform(range(0, k), lambda j: (m - k - j) / (m - j))), 6) AS chance FROM p WHERE k > 0")
def _(spark, d):
    n = table(spark, d, "customer").agg((F.count("*") - 1).alias("m"))
    return n.select("m", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("k")).select("k", F.round(C.zero_overlap_chance(F.col("m"), F.col("k")), 6).alias("chance"))


@R.add("f1_byte_order_sort", "SELECT p_name, p_partkey, row_number() OVER (ORDER BY p_name COLLATE C, p_partkey) AS place FROM part")
def _(spark, d):
    return bins.canonical_order(table(spark, d, "part").select("p_name", "p_partkey"), [F.col("p_name"), F.col("p_partkey")], "place")
