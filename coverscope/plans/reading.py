"""Queries on sources and sinks (A)."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from coverscope.operators import bins, scratch
from coverscope.plans.frames import table
from coverscope.plans.joining import squares
from coverscope.plans.registry import Registry
from coverscope.sources import cells, files

R = Registry()


@R.add("a1_read_table", 'SELECT n_nationkey AS "Area code (2021)", n_name AS "Area name", n_regionkey AS "Region" FROM nation')
def _(spark, d):
    out = scratch.folder(spark, "files")
    files.write_table(table(spark, d, "nation").select(F.col("n_nationkey").alias("Area code (2021)"), F.col("n_name").alias("Area name"), F.col("n_regionkey").alias("Region")), out)
    return files.read_table(spark, out, "`Area code (2021)` int, `Area name` string, `Region` int")


@R.add("a2_read_zip_csv", "SELECT s_suppkey, s_acctbal, 'lsoa.csv' AS member FROM supplier")
def _(spark, d):
    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("msoa-lsoa.csv", "s_suppkey,s_acctbal\n0,0\n")
            z.writestr("lsoa.csv", pdf[["s_suppkey", "s_acctbal"]].to_csv(index=False))
            z.writestr("lsoa-long-name.csv", "s_suppkey,s_acctbal\n")
        return pd.DataFrame({"path": [f"n{key[0]}.zip"], "content": [data.getvalue()]})

    packed = table(spark, d, "supplier").groupBy("s_nationkey").applyInPandas(pack, "path string, content binary")
    return files.read_zip_csv(packed, "s_suppkey bigint, s_acctbal double", "lsoa", "msoa").select("s_suppkey", "s_acctbal", "member")


def pages(spark, d, size=400):
    """Customers as JSON pages of features."""
    k = F.col("c_custkey")
    feature = F.struct(F.struct(k.alias("code"), F.when(k % 7 != 0, F.col("c_name")).alias("name")).alias("attributes"), F.struct((k * 2.0).alias("x"), (k + 0.5).alias("y")).alias("geometry"))
    return table(spark, d, "customer").groupBy(F.floor(k / size).alias("page")).agg(F.to_json(F.struct(F.sort_array(F.collect_list(feature)).alias("features"))).alias("value"))


@R.add("a3_read_feature_pages", "SELECT c_custkey AS code, CASE WHEN c_custkey % 7 = 0 THEN '-' ELSE c_name END AS name, c_custkey * 2.0::DOUBLE AS x, c_custkey + 0.5::DOUBLE AS y FROM customer")
def _(spark, d):
    out = scratch.folder(spark, "files")
    pages(spark, d).write.partitionBy("page").text(out)  # a file for each page
    return files.read_feature_pages(spark, f"{out}/page=*", {"code": "bigint", "name": "string"}, geometry=True).select("code", F.coalesce("name", F.lit("-")).alias("name"), "x", "y")


@R.add("a4_audit_pages", "WITH t AS (SELECT count(*) AS t FROM customer) SELECT (c_custkey // 400)::DOUBLE AS page, count(*) AS n, least(400, max(t) - (c_custkey // 400) * 400)::BIGINT AS expected, count(*) = least(400, max(t) - (c_custkey // 400) * 400) AS passed FROM customer, t GROUP BY c_custkey // 400 UNION ALL SELECT -1.0, count(DISTINCT c_custkey), count(*), true FROM customer")
def _(spark, d):
    rows = table(spark, d, "customer").withColumn("page", F.floor(F.col("c_custkey") / 400))
    out = files.audit_pages(rows, "page", "c_custkey", 400)
    return out.withColumn("page", F.coalesce("page", F.lit(-1)).cast("double"))


@R.add("a5_read_geojson", "WITH f AS (SELECT DISTINCT floor((((s_suppkey*7919) % 10007 * 10 + 0.5)::DOUBLE) / 10000)::BIGINT AS cx, floor((((s_suppkey*104729) % 10009 * 10 + 0.5)::DOUBLE) / 10000)::BIGINT AS cy FROM supplier) SELECT cx * 100 + cy AS polygon, (CASE WHEN cy % 3 = 0 THEN 3 WHEN cy % 3 = 1 THEN 2 ELSE 1 END)::INT AS n_rings, (CASE WHEN cy % 3 = 0 THEN 12 WHEN cy % 3 = 1 THEN 8 ELSE 4 END)::INT AS n_corners, cx * 10000.0::DOUBLE AS x0, cy * 10000.0::DOUBLE AS y0 FROM f")
def _(spark, d):
    """Squares as GeoJSON: some with a hole, some of two parts, some plain."""
    corners = F.transform("ring", lambda p: F.array(p["x"], p["y"]))
    hole = F.transform("ring", lambda p: F.array((p["x"] + F.get("ring", F.lit(0))["x"] + F.get("ring", F.lit(2))["x"]) / 3, (p["y"] + F.get("ring", F.lit(0))["y"] + F.get("ring", F.lit(2))["y"]) / 3))
    part = F.transform("ring", lambda p: F.array(p["x"] + 1e6, p["y"]))
    text = F.when(F.col("polygon") % 100 % 3 == 0, F.to_json(F.array(F.array(corners, hole), F.array(part)))).when(F.col("polygon") % 100 % 3 == 1, F.to_json(F.array(corners, hole))).otherwise(F.to_json(F.array(corners)))
    kind = F.when(F.col("polygon") % 100 % 3 == 0, "MultiPolygon").otherwise("Polygon")
    feature = F.concat(F.lit('{"type": "Feature", "properties": {"polygon": '), F.col("polygon").cast("string"), F.lit('}, "geometry": {"type": "'), kind, F.lit('", "coordinates": '), text, F.lit("}}"))
    pages_ = squares(spark, d).select("polygon", feature.alias("feature")).groupBy((F.col("polygon") % 5).alias("part")).agg(F.concat(F.lit('{"features": ['), F.array_join(F.collect_list("feature"), ", "), F.lit("]}")).alias("value"))
    got = files.read_geojson(pages_, "value", {"polygon": "bigint"})
    first = F.get(F.get("rings", F.lit(0)), F.lit(0))
    return got.select("polygon", F.size("rings").alias("n_rings"), F.size(F.flatten("rings")).alias("n_corners"), first["x"].alias("x0"), first["y"].alias("y0"))


def sheet(spark, d):
    """nation and its supplier counts as a sheet: two header rows (the first one merged), then data."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("k"), "n_name", "n_regionkey")
    row = (F.col("k") + 3).alias("row")
    body = [n.select(F.lit("s1").alias("sheet"), row, F.lit(c).alias("col"), v.cast("string").alias("value")) for c, v in ((1, F.col("n_name")), (2, F.col("n_regionkey")), (3, F.col("k") * 1000), (4, F.when(F.col("k") % 2 == 0, F.lit("..")).otherwise(F.col("k").cast("string"))))]
    heads = spark.createDataFrame([("s1", 1, 1, "Area"), ("s1", 1, 2, "Counts"), ("s1", 1, 3, None), ("s1", 1, 4, ""), ("s1", 2, 1, "Area"), ("s1", 2, 2, "Region"), ("s1", 2, 3, "Total (n)"), ("s1", 2, 4, "Odd")], "sheet string, row int, col int, value string")
    out = heads
    for b in body:
        out = out.unionByName(b)
    return out


@R.add("a6_detect_code_column", "SELECT 's1' AS sheet, 1 AS code_column, count(*) AS hits, (min(n_nationkey) + 3)::INT AS first_row FROM nation")
def _(spark, d):
    return cells.detect_code_column(sheet(spark, d), "^NATION_[0-9]+$", 10)


def census(spark, d):
    """Customers by nation and segment as a sheet, a column for each nation: names of regions over the first of their nations alone (merged cells), names of nations, then counts."""
    n = bins.canonical_order(table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")), [F.col("n_regionkey"), F.col("n_nationkey")], "_place").select("n_nationkey", "n_regionkey", "n_name", "r_name", (F.col("_place") + 1).cast("int").alias("col"))
    first = n.groupBy("n_regionkey").agg(F.min("col").alias("_first"))
    top = n.join(first, "n_regionkey").select(F.lit(1).alias("row"), "col", F.when(F.col("col") == F.col("_first"), F.col("r_name")).otherwise("").alias("value"))
    names = n.select(F.lit(2).alias("row"), "col", F.col("n_name").alias("value"))
    c = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    segments = bins.canonical_order(c.select("c_mktsegment").distinct(), "c_mktsegment", "_place").select("c_mktsegment", (F.col("_place") + 2).cast("int").alias("row"))
    body = c.join(segments, "c_mktsegment").join(n.select(F.col("n_nationkey").alias("c_nationkey"), "col"), "c_nationkey").select("row", "col", F.col("n").cast("string").alias("value"))
    stub = segments.select("row", F.lit(1).alias("col"), F.col("c_mktsegment").alias("value"))
    return top.unionByName(names).unionByName(body).unionByName(stub).select(F.lit("census").alias("sheet"), "row", "col", "value")


NATIONS = "n AS (SELECT n_nationkey, n_regionkey, n_name, r_name, (1 + row_number() OVER (ORDER BY n_regionkey, n_nationkey))::INT AS col FROM nation JOIN region ON n_regionkey = r_regionkey)"


@R.add("a7_resolve_header_tokens", f"WITH {NATIONS} SELECT regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS token, col FROM n WHERE n_regionkey >= 2 UNION ALL SELECT regexp_replace(lower(r_name), '[^a-z0-9]', '', 'g'), min(col) FROM n GROUP BY r_name")
def _(spark, d):
    wanted = table(spark, d, "nation").where("n_regionkey >= 2").select(F.col("n_name").alias("token")).unionByName(table(spark, d, "region").select(F.upper("r_name").alias("token")))
    return cells.resolve_header_tokens(census(spark, d).where("row <= 2"), wanted)


@R.add("a8_merge_headers", f"WITH {NATIONS} SELECT 'census' AS sheet, col, r_name || ' | ' || n_name AS label FROM n")
def _(spark, d):
    return cells.merge_headers(census(spark, d).where("row <= 2"))


@R.add("e13_forward_fill", f"WITH {NATIONS} SELECT 'census' AS sheet, 1 AS \"row\", col, r_name AS filled FROM n UNION ALL SELECT 'census', 2, col, n_name FROM n")
def _(spark, d):
    return cells.fill_right(census(spark, d).where("row <= 2")).select("sheet", "row", "col", "filled")


@R.add("e13_prefix_scan", "SELECT o_orderkey, last_value(CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey END IGNORE NULLS) OVER w AS last_urgent, sum((o_totalprice * 100)::BIGINT) OVER w::BIGINT AS running_cents FROM orders WINDOW w AS (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey")).alias("_urgent"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("_cents"))
    return bins.prefix_scan(o, ["o_orderkey"], {"last_urgent": ("last", "_urgent"), "running_cents": ("sum", "_cents")}).select("o_orderkey", "last_urgent", "running_cents")


@R.add("a9_select_covered_columns", "SELECT 's1' AS sheet, 2 AS col, 'Counts | Region' AS label, count(*) AS n FROM nation UNION ALL SELECT 's1', 3, 'Counts | Total (n)', count(*) FROM nation")
def _(spark, d):
    s = sheet(spark, d)
    return cells.select_covered_columns(s.where("row > 2"), cells.merge_headers(s.where("row <= 2")), "^Counts", 20)


CANDIDATE = "SELECT {0} AS priority, '{1}' AS source, '{2}' AS column, count({2}) / count(*) AS coverage, count(DISTINCT {2}) AS n_distinct, min({2})::DOUBLE AS lo, max({2})::DOUBLE AS hi, round(avg({2}), 6) AS mean, bool_and(abs({2} - round({2})) < 1e-8) AS integer_like, {3} AS score, {4} AS rank FROM {1}"


@R.add("a12_resolve_readout", " UNION ALL ".join(CANDIDATE.format(*x) for x in ((0, "orders", "o_totalprice", 2, 1), (1, "lineitem", "l_extendedprice", 1, 2), (2, "part", "p_retailprice", 1, 3))))
def _(spark, d):
    return cells.resolve_readout({"orders": table(spark, d, "orders"), "lineitem": table(spark, d, "lineitem"), "part": table(spark, d, "part")}, "o_totalprice|extendedprice|retailprice", low=0.0, mean_low=100.0).withColumn("mean", F.round("mean", 6))


@R.add("a13_write_table", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(spark, d):
    out = scratch.folder(spark, "files")
    files.write_table(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), out, gzip=True)
    return files.read_table(spark, out, "c_custkey bigint, c_name string, c_acctbal double")


@R.add("a14_file_manifest")
def _(spark, d):
    return files.file_manifest(spark, f"{d}/nation.parquet")


@R.add("a15_verify_manifest")
def _(spark, d):
    m = files.file_manifest(spark, f"{d}/region.parquet").persist()
    listed = m.unionByName(m.select(F.concat("path", F.lit(".gone")).alias("path"), "bytes", "sha256"))
    return files.verify_manifest(listed, m)


@R.add(
    "a15_immutable_manifest",
    "SELECT c_nationkey::INT AS role, CASE WHEN c_nationkey % 5 = 4 THEN 'CHANGED' WHEN c_nationkey % 5 = 3 THEN 'DUPLICATE' WHEN c_nationkey % 2 = 1 THEN 'MUTABLE' ELSE 'OK' END AS status, count(DISTINCT 1) AS n FROM customer WHERE c_nationkey % 5 <> 2 GROUP BY c_nationkey"
    " UNION ALL SELECT c_nationkey::INT, 'UNLISTED', 1 FROM customer WHERE c_nationkey % 5 = 2 GROUP BY c_nationkey UNION ALL SELECT c_nationkey::INT, 'MISSING', 1 FROM customer GROUP BY c_nationkey",
)
def _(spark, d):
    """Customers in a file for each nation, against a list with changed hashes, files listed twice, left out or gone, and marks."""
    out, nation = scratch.folder(spark, "files"), F.regexp_extract("path", "c_nationkey=([0-9]+)", 1).cast("int")
    table(spark, d, "customer").repartition("c_nationkey").write.partitionBy("c_nationkey").parquet(out)
    found = files.file_manifest(spark, out, "*.parquet")
    key, mark = nation % 5, F.when(nation % 2 == 0, "Yes").otherwise("no")
    listed = found.where(key != 2).select("path", F.when(key == 4, F.reverse("sha256")).otherwise(F.upper("sha256")).alias("sha256"), mark.alias("immutable"))
    gone = found.select(F.concat("path", F.lit(".gone")).alias("path"), "sha256", F.lit("yes").alias("immutable"))
    checked = files.verify_manifest(listed.unionByName(listed.where(key == 3)).unionByName(gone), found, immutable=True)
    return checked.groupBy(nation.alias("role"), "status").agg(F.count("*").alias("n"))
