"""Queries on cleaning, scaling and labelling (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from coverscope.functions import columns as C
from coverscope.operators import scale, tidy
from coverscope.plans.frames import UNITS, table, units
from coverscope.plans.registry import Registry

R = Registry()


@R.add("b1_normalise_names", "SELECT s_suppkey AS supplier_key, s_name AS s_name, s_acctbal AS s_name_2, s_nationkey AS cafe_strasse FROM supplier")
def _(spark, d):
    odd = table(spark, d, "supplier").select(F.col("s_suppkey").alias(" Supplier  Key%"), F.col("s_name").alias("S.Name"), F.col("s_acctbal").alias("s name"), F.col("s_nationkey").alias("Café-Straße"))
    return tidy.normalise_names(odd)


@R.add("h_strip_accents", "SELECT doc_id, md5(strip_accents(text)) AS plain, strip_accents(text) <> text AS changed FROM documents")
def _(spark, d):
    plain = C.strip_accents(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(plain).alias("plain"), (plain != F.col("text")).alias("changed"))


@R.add("h_valid_utf8", "SELECT doc_id, text = '' OR unicode(text) < 128 AS rest_is_valid, text IS NOT NULL AS is_valid FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    """A text without its first byte is valid if that byte was a whole character."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", C.valid_utf8(F.expr("substring(cast(text AS binary), 2)")).alias("rest_is_valid"), C.valid_utf8(F.col("text")).alias("is_valid"))


@R.add("b3_find_key_column", "SELECT 'c_name' AS key_column, (SELECT avg(CASE WHEN regexp_matches(c_name, '^Customer#[0-9]{9}$') THEN 1.0 ELSE 0.0 END) FROM customer)::DOUBLE AS share")
def _(spark, d):
    return tidy.find_key_column(table(spark, d, "customer"), r"^Customer#[0-9]{9}$", 0.9)


@R.add("b4_regex_filter", "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '^(ECONOMY|STANDARD)')")
def _(spark, d):
    return table(spark, d, "part").where(F.col("p_type").rlike("^(ECONOMY|STANDARD)")).select("p_partkey", "p_type")


@R.add("b5_rename_provenance", "SELECT n_nationkey AS unit_id, n_name AS unit_label, 'nation' AS source_table, 2024 AS vintage FROM nation")
def _(spark, d):
    return tidy.with_provenance(table(spark, d, "nation").withColumnsRenamed({"n_nationkey": "unit_id", "n_name": "unit_label"}).select("unit_id", "unit_label"), source_table="nation", vintage=2024)


@R.add(
    "b6_to_number",
    """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN NULL ELSE round(1000 * p_retailprice) END AS value FROM part""",
)
def _(spark, d):
    text = F.when(F.col("p_partkey") % 7 == 0, "..").when(F.col("p_partkey") % 11 == 0, "x12").otherwise(F.concat(F.lit(" "), F.format_number(F.round(1000 * F.col("p_retailprice")), 0)))
    return table(spark, d, "part").select("p_partkey", C.to_number(text).alias("value"))


@R.add(
    "b7_pct",
    """SELECT l_orderkey, round(100.0 * sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / nullif(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END), 0), 6) AS share
FROM lineitem GROUP BY l_orderkey""",
)
def _(spark, d):
    part = lambda c, v: F.sum(F.when(F.col(c) == v, F.col("l_quantity")).otherwise(0.0))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(C.pct(part("l_returnflag", "R"), part("l_linestatus", "F")), 6).alias("share"))


SIZES = [("^(ECONOMY|SMALL)", "A"), ("^(MEDIUM|STANDARD)", "B"), ("^LARGE", "C"), ("^PROMO", "D")]


@R.add(
    "b8_bucket_by_pattern",
    """SELECT p_partkey, CASE WHEN regexp_matches(p_type, '^(ECONOMY|SMALL)') THEN 'A' WHEN regexp_matches(p_type, '^(MEDIUM|STANDARD)') THEN 'B'
 WHEN regexp_matches(p_type, '^LARGE') THEN 'C' WHEN regexp_matches(p_type, '^PROMO') THEN 'D' ELSE 'UNKNOWN' END AS bucket FROM part""",
)
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", C.bucket_by_pattern(C.clean_text(F.col("p_type")), SIZES).alias("bucket"))


@R.add(
    "b9_membership_flag",
    "SELECT s_suppkey, s_suppkey % 4 IN (1, 2, 3) AS in_set, s_acctbal IS NOT NULL AS valid FROM supplier",
)
def _(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 4).isin(1, 2, 3).alias("in_set"), C.finite(F.col("s_acctbal")).isNotNull().alias("valid"))


@R.add("b10_to_binary", "SELECT event_id, (CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 END)::DOUBLE AS flag FROM events")
def _(spark, d):
    word = F.element_at(F.array(*[F.lit(x) for x in (" Yes", "FALSE", "flagged", "maybe")]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", C.to_binary(word).cast("double").alias("flag"))


@R.add("b11_fill_category", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'UNRESOLVED' ELSE c_mktsegment END AS category FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", C.fill_category(F.when(F.col("c_custkey") % 10 == 0, "  ").when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))).alias("category"))


@R.add(
    "b12_one_hot",
    "SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{s}')::INT AS c_mktsegment_{s}" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer",
)
def _(spark, d):
    return scale.one_hot(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment").drop("c_mktsegment")


@R.add("b13_log1p", f"WITH {UNITS} SELECT id, round(a1, 6) AS a1 FROM units")
def _(spark, d):
    return units(spark, d).select("id", F.round("a1", 6).alias("a1"))


@R.add("b14_scale_z_score", f"WITH {UNITS} SELECT id, round((a1 - avg(a1) OVER ()) / stddev_samp(a1) OVER (), 6) AS z1, round((a2 - avg(a2) OVER ()) / stddev_samp(a2) OVER (), 6) AS z2 FROM units")
def _(spark, d):
    return scale.z_score(units(spark, d).select("id", "a1", "a2"), {"a1": "z1", "a2": "z2"}, 6).select("id", "z1", "z2")


@R.add(
    "b15_scale_mad",
    f"WITH {UNITS}, m AS (SELECT *, median(a2) OVER () AS c FROM units), s AS (SELECT *, 1.4826 * median(abs(a2 - c)) OVER () AS s FROM m) SELECT id, round((a2 - c) / s, 6) AS r2 FROM s",
)
def _(spark, d):
    return scale.mad(units(spark, d).select("id", "a2"), {"a2": "r2"}).select("id", F.round("r2", 6).alias("r2"))


RANKED = "r AS (SELECT *, rank() OVER (ORDER BY n_orders) + (count(*) OVER (PARTITION BY n_orders) - 1) / 2.0 AS k FROM units)"


@R.add("b16_scale_rank", f"WITH {UNITS}, {RANKED} SELECT id, round((k - avg(k) OVER ()) / stddev_samp(k) OVER (), 6) AS score FROM r")
def _(spark, d):
    return scale.rank_score(units(spark, d).select("id", "n_orders"), "n_orders", "score").select("id", F.round("score", 6).alias("score"))


@R.add("b17_scale_none", f"WITH {UNITS} SELECT id, round(a1, 6) AS a1, round(a2, 6) AS a2, round(a3, 6) AS a3 FROM units")
def _(spark, d):
    return units(spark, d).select("id", *[F.round(c, 6).alias(c) for c in ("a1", "a2", "a3")])


@R.add(
    "b18_nor_legacy",
    f"WITH {UNITS}, m AS (SELECT *, min(a2) OVER () AS lo, max(a2) OVER () AS hi FROM units) SELECT id, round(a2 - lo / (hi - lo), 6) AS nor, round((a2 - lo) / (hi - lo), 6) AS min_max FROM m",
)
def _(spark, d):
    both = scale.min_max(scale.nor_legacy(units(spark, d).select("id", "a2"), "a2", "nor"), "a2", "min_max")
    return both.select("id", F.round("nor", 6).alias("nor"), F.round("min_max", 6).alias("min_max"))


@R.add(
    "b19_quartile_flags",
    f"""WITH {UNITS}, q AS (SELECT *, quantile_cont(a1, 0.75) OVER () AS q1, quantile_cont(a2, 0.25) OVER () AS q2 FROM units)
SELECT id, a1 >= q1 AS a1_high, a2 <= q2 AS a2_low, a1 >= q1 AND a2 <= q2 AS all_flags FROM q""",
)
def _(spark, d):
    return scale.quartile_flags(units(spark, d).select("id", "a1", "a2"), {"a1": "high", "a2": "low"}).select("id", "a1_high", "a2_low", "all_flags")


LEVEL = "CASE WHEN z >= 1 THEN 'very_high' WHEN z <= -1 THEN 'very_low' WHEN z >= 0.5 THEN 'high' WHEN z <= -0.5 THEN 'low' ELSE 'near' END"


@R.add("b20_level", f"WITH {UNITS}, z AS (SELECT id, round((a2 - avg(a2) OVER ()) / stddev_samp(a2) OVER (), 9) AS z FROM units) SELECT id, {LEVEL} AS level FROM z")
def _(spark, d):
    return scale.z_score(units(spark, d).select("id", "a2"), {"a2": "z"}, 9).select("id", C.level(F.col("z")).alias("level"))


@R.add("b21_strength_flag", f"WITH {UNITS} SELECT id, CASE WHEN urgent IS NULL THEN 'NOT_AVAILABLE' WHEN urgent >= 200000 THEN 'STRONG' WHEN urgent >= 100000 THEN 'MODERATE' ELSE 'CAUTIOUS' END AS flag FROM units")
def _(spark, d):
    return units(spark, d).select("id", C.strength_flag(F.col("urgent"), 200000, 100000).alias("flag"))


@R.add(
    "b22_profile_signature",
    f"""WITH {UNITS}, p AS (SELECT id, round((a1 - avg(a1) OVER ()) / stddev_samp(a1) OVER (), 9) AS z1, round((a2 - avg(a2) OVER ()) / stddev_samp(a2) OVER (), 9) AS z2,
 round((a3 - avg(a3) OVER ()) / stddev_samp(a3) OVER (), 9) AS z3 FROM units)
SELECT id, round((z1 + z2 + z3) / 3, 6) AS mean, round(sqrt(z1*z1 + z2*z2 + z3*z3), 6) AS norm,
 CASE WHEN z1 >= z2 AND z1 >= z3 THEN 'z1' WHEN z2 >= z3 THEN 'z2' ELSE 'z3' END AS highest,
 CASE WHEN z1 <= z2 AND z1 <= z3 THEN 'z1' WHEN z2 <= z3 THEN 'z2' ELSE 'z3' END AS lowest,
 CASE WHEN abs(z1) >= abs(z2) AND abs(z1) >= abs(z3) THEN 'z1' WHEN abs(z2) >= abs(z3) THEN 'z2' ELSE 'z3' END AS largest,
 {LEVEL.replace('z ', 'z1 ')} || '|' || {LEVEL.replace('z ', 'z2 ')} || '|' || {LEVEL.replace('z ', 'z3 ')} AS signature FROM p""",
)
def _(spark, d):
    from coverscope.plans.frames import AXES, points

    p = tidy.profile_signature(points(spark, d), AXES)
    return p.select("id", F.round("mean", 6).alias("mean"), F.round("norm", 6).alias("norm"), "highest", "lowest", "largest", "signature")


@R.add(
    "b23_format_number",
    """SELECT c_custkey, CASE WHEN abs(c_acctbal - round(c_acctbal)) <= 1e-9 THEN format('{:,}', round(c_acctbal)::BIGINT) ELSE format('{:,.2f}', c_acctbal) END AS shown FROM customer""",
)
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", C.format_number_strict(F.col("c_acctbal")).alias("shown"))


@R.add("b24_first_nonmissing", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS value FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", C.first_nonmissing(F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).otherwise(F.lit(" ")), F.col("c_mktsegment")).alias("value"))


@R.add("b25_safe_stats", f"WITH {UNITS} SELECT class, round(avg(urgent), 6) AS mean, min(urgent) AS lo, max(urgent) AS hi, round(stddev_samp(urgent), 6) AS sd FROM units GROUP BY class")
def _(spark, d):
    odd = units(spark, d).withColumn("v", C.finite(F.coalesce("urgent", F.lit(float("nan")))))
    return odd.groupBy("class").agg(F.round(F.avg("v"), 6).alias("mean"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.round(F.stddev_samp("v"), 6).alias("sd"))


@R.add(
    "b27_mentions_ids",
    """SELECT p_partkey, r_regionkey FROM part, region WHERE r_regionkey > 0 AND list_contains(string_split('see ' || p_size || ', ' || p_size || '0 B' || p_size || ' end', ' '), r_regionkey || ',')""",
)
def _(spark, d):
    text = F.concat(F.lit("see "), F.col("p_size"), F.lit(", "), F.col("p_size"), F.lit("0 B"), F.col("p_size"), F.lit(" end"))
    ids = table(spark, d, "region").where("r_regionkey > 0").select("r_regionkey")
    return tidy.mentioned_ids(table(spark, d, "part").select("p_partkey", text.alias("text")), "text", ids, "r_regionkey").select("p_partkey", "r_regionkey")
