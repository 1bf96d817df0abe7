"""Data contracts: checks as rows, each from one aggregate job."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from coverscope.functions.columns import finite
from coverscope.operators.joins import ContractError


def rules_of(df: DataFrame, min_rows: int = 1, exact_rows: int | None = None, required: Sequence[str] = (), non_missing: Sequence[str] = (), numeric: Sequence[str] = (), positive: Sequence[str] = (), non_negative: Sequence[str] = (), integer_like: Sequence[str] = (), bounds: dict[str, tuple[float, float]] | None = None, varying: Sequence[str] = (), tidy: Sequence[str] = ()) -> dict[str, Column]:
    """Aggregates that count violations, by the name of the rule."""
    absent = [c for c in required if c not in df.columns]
    n = F.count("*")
    bad = lambda c, ok: F.count_if(F.col(c).isNotNull() & ~F.coalesce(ok, F.lit(False)))
    rules = {"min_rows": F.when(n >= min_rows, 0).otherwise(1), "required_columns": F.lit(len(absent))}
    if exact_rows is not None:
        rules["exact_rows"] = F.abs(n - exact_rows)
    rules |= {f"non_missing:{c}": F.count_if(F.col(c).isNull()) for c in non_missing}
    rules |= {f"finite:{c}": F.count_if(finite(F.col(c)).isNull()) for c in numeric}
    rules |= {f"positive:{c}": bad(c, F.col(c) > 0) for c in positive}
    rules |= {f"non_negative:{c}": bad(c, F.col(c) >= 0) for c in non_negative}
    rules |= {f"integer_like:{c}": bad(c, F.abs(F.col(c) - F.round(c)) <= 1e-9) for c in integer_like}
    rules |= {f"bounds:{c}": bad(c, F.col(c).between(lo, hi)) for c, (lo, hi) in (bounds or {}).items()}
    rules |= {f"varying:{c}": F.when(F.min(c) < F.max(c), 0).otherwise(1) for c in varying}
    rules |= {f"trimmed:{c}": bad(c, F.col(c) == F.trim(F.col(c))) for c in tidy}
    return rules


def table_contract(df: DataFrame, key: str | None = None, **spec) -> DataFrame:
    """check, violations and passed for each rule of spec (see rules_of); one aggregate job."""
    rules = rules_of(df, **spec)
    if key:
        rules[f"unique:{key}"] = F.count("*") - F.count_distinct(key)
    one = df.agg(*[v.cast("bigint").alias(k) for k, v in rules.items()])
    return one.unpivot([], [f"`{k}`" for k in rules], "check", "violations").withColumn("passed", F.col("violations") == 0)


def write_checked(df: DataFrame, path: str, key: str | None = None, **spec) -> DataFrame:
    """Writes df as Parquet to path if all rules of spec hold; the report (check, violations, passed). A broken table is an error and leaves nothing behind.

    The rules are observed while the rows are written to a staging path beside it, so the table is computed once;
    a unique key needs its own column read again from there. Only then the staging path gets its name."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target, staged = hadoop(path), hadoop(f"{path}.staging-{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise ContractError(f"{path} exists")
    rules, seen = rules_of(df, **spec), Observation()
    try:
        df.observe(seen, *[v.cast("bigint").alias(k) for k, v in rules.items()]).write.parquet(staged.toString())
        found = dict(seen.get)
        if key:
            found[f"unique:{key}"] = spark.read.parquet(staged.toString()).agg(F.count("*") - F.count_distinct(key)).first()[0]
        failed = [k for k, v in found.items() if v]
        if failed:
            raise ContractError(", ".join(failed))
        if not fs.rename(staged, target):
            raise ContractError(f"{path} could not be published")
    finally:
        fs.delete(staged, True)
    return spark.createDataFrame([(k, int(v), True) for k, v in found.items()], "check string, violations bigint, passed boolean")


def enforce(report: DataFrame) -> None:
    """Raises if a check of a report failed."""
    failed = [r["check"] for r in report.where(~F.col("passed")).collect()]
    if failed:
        raise ContractError(", ".join(failed))


def compare_frames(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str], absolute: float = 0.0, relative: float = 0.0) -> DataFrame:
    """variable, n_both, n_only_a, n_only_b, mismatches (nulls equal nulls), max_abs_diff, and status EXACT, TOLERANCE_EQUIVALENT or FAIL."""
    left, right = a.select(key, *[F.col(c).alias(f"_a{c}") for c in columns], F.lit(1).alias("_l")), b.select(key, *[F.col(c).alias(f"_b{c}") for c in columns], F.lit(1).alias("_r"))
    both = left.join(right, key, "full")
    met = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    found = []
    kinds = dict(a.dtypes)
    for c in columns:
        x, y = F.col(f"_a{c}"), F.col(f"_b{c}")
        d = F.abs(x - y) if kinds[c] in ("double", "float", "int", "bigint") else F.when(x != y, 1e308).otherwise(0.0)
        same = x.eqNullSafe(y)
        near = same | F.coalesce(d <= absolute + relative * F.greatest(F.abs(x), F.abs(y)) if kinds[c] in ("double", "float", "int", "bigint") else F.lit(False), F.lit(False))
        found.append(F.struct(F.lit(c).alias("variable"), F.count_if(met).alias("n_both"), F.count_if(F.col("_r").isNull()).alias("n_only_a"), F.count_if(F.col("_l").isNull()).alias("n_only_b"), F.count_if(met & ~same).alias("n_different"), F.count_if(met & ~near).alias("mismatches"), F.max(F.when(met, d)).cast("double").alias("max_abs_diff")))
    rows = both.agg(F.array(*found).alias("_r")).select(F.inline("_r"))
    lost = (F.col("n_only_a") > 0) | (F.col("n_only_b") > 0)
    return rows.withColumn("status", F.when(lost | (F.col("mismatches") > 0), "FAIL").when(F.col("n_different") == 0, "EXACT").otherwise("TOLERANCE_EQUIVALENT"))


def composition_gap(df: DataFrame, parts: Sequence[str], total: str, tolerance: float) -> DataFrame:
    gap = F.abs(sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0)) - F.col(total))
    return df.agg(F.max(gap).alias("max_gap"), F.count_if(gap > tolerance).alias("n_beyond")).withColumn("passed", F.col("n_beyond") == 0)


def verify_expected(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """name, expected, observed, passed, blocking. observed: name and value; expected: name, value, tolerance and blocking."""
    o = observed.select("name", F.col("value").alias("observed"))
    out = expected.withColumnRenamed("value", "expected").join(o, "name", "left")
    return out.select("name", "expected", "observed", F.coalesce(F.abs(F.col("expected") - F.col("observed")) <= F.col("tolerance"), F.lit(False)).alias("passed"), "blocking")


def overall_status(checks: DataFrame) -> DataFrame:
    return checks.agg(F.when(F.count_if(~F.col("passed") & F.col("blocking")) > 0, "FAIL").when(F.count_if(~F.col("passed")) > 0, "WARN").otherwise("PASS").alias("status"), F.count("*").alias("n_checks"), F.count_if("passed").alias("n_passed"))


def exclude_values(df: DataFrame, column: str, values: Sequence, min_removed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(df without rows of the values, audit row). All values must occur, enough rows go and some stay; else an error."""
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], [column])
    counts = df.agg(F.count("*").alias("n_before"), F.count_if(F.col(column).isin(*values)).alias("n_removed"), F.count_distinct(F.when(F.col(column).isin(*values), F.col(column))).alias("n_values"))
    audit = counts.withColumns({"n_after": F.col("n_before") - F.col("n_removed"), "n_requested": F.lit(len(set(values)))})
    r = audit.first()
    if r["n_values"] < r["n_requested"] or r["n_removed"] < min_removed or not r["n_after"]:
        raise ContractError(f"exclusion of {column} is not allowed: {r.asDict()}")
    return df.join(F.broadcast(wanted), column, "left_anti"), audit


def scan_status(df: DataFrame, column: str, pattern: str = r"(?i)\b(fail|failed|error|abort)") -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count_if(F.col(column).rlike(pattern)).alias("n_bad")).withColumn("passed", F.col("n_bad") == 0)


def qa_summary(df: DataFrame, key: str, pattern: str, measures: Sequence[str]) -> DataFrame:
    """metric and value: rows, distinct and repeated keys, malformed keys, missing values."""
    one = df.agg(
        F.count("*").alias("rows"),
        F.count_distinct(key).alias("unique_keys"),
        (F.count(key) - F.count_distinct(key)).alias("repeated_keys"),
        F.count_if(~F.col(key).cast("string").rlike(pattern)).alias("malformed_keys"),
        *[F.count_if(F.col(m).isNull()).alias(f"missing_{m}") for m in measures],
    )
    return one.unpivot([], one.columns, "metric", "value")
