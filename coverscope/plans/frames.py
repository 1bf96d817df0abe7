"""Frames that the queries share: units (customers with three axes), coordinates, facilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coverscope.operators import scale

AXES = ["z1", "z2", "z3"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, category, class, a1, a2, a3, n_orders and urgent (null for customers without urgent orders)."""
    high = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1.0).otherwise(0.0)
    per = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("id"))
        .agg(
            F.sum("o_totalprice").alias("spend"),
            F.count("*").alias("n_orders"),
            (100.0 * F.avg(high)).alias("a3"),
            F.avg(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))).alias("urgent"),
        )
    )
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("class"))
    return (
        table(spark, sf_dir, "customer")
        .withColumnRenamed("c_custkey", "id")
        .join(per, "id", "left")
        .join(nation, "c_nationkey")
        .select(
            "id",
            F.col("c_name").alias("label"),
            F.col("c_mktsegment").alias("category"),
            "class",
            F.log1p(F.coalesce("spend", F.lit(0.0))).alias("a1"),
            F.col("c_acctbal").alias("a2"),
            F.coalesce("a3", F.lit(0.0)).alias("a3"),
            F.coalesce("n_orders", F.lit(0)).alias("n_orders"),
            "urgent",
        )
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """units with z-scores z1, z2 and z3 of the axes, rounded to 9 digits."""
    return scale.z_score(units(spark, sf_dir), {"a1": "z1", "a2": "z2", "a3": "z3"}, digits=9)


def x_of(key: Column) -> Column:
    return ((key * 7919) % 10007 * 10).cast("double") + 0.5


def y_of(key: Column) -> Column:
    return ((key * 104729) % 10009 * 10).cast("double") + 0.5


UNITS = """ord AS (SELECT o_custkey, sum(o_totalprice) AS spend, count(*) AS n_orders,
  100.0 * avg(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1.0 ELSE 0.0 END) AS a3,
  avg(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS urgent FROM orders GROUP BY o_custkey),
units AS (SELECT c_custkey AS id, c_name AS label, c_mktsegment AS category, n_regionkey AS class,
  ln(1 + coalesce(spend, 0)) AS a1, c_acctbal AS a2, coalesce(a3, 0) AS a3, coalesce(n_orders, 0) AS n_orders, urgent
  FROM customer LEFT JOIN ord ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey)"""
POINTS = (
    UNITS
    + """,
points AS (SELECT *, round((a1 - avg(a1) OVER ()) / stddev_samp(a1) OVER (), 9) AS z1,
  round((a2 - avg(a2) OVER ()) / stddev_samp(a2) OVER (), 9) AS z2,
  round((a3 - avg(a3) OVER ()) / stddev_samp(a3) OVER (), 9) AS z3 FROM units)"""
)


def xy(key: str) -> str:
    """SQL of the coordinates of an integer key."""
    return f"(({key}*7919) % 10007 * 10 + 0.5)::DOUBLE AS x, (({key}*104729) % 10009 * 10 + 0.5)::DOUBLE AS y"
