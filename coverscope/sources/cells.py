"""Tables out of sheets that were read as cells: sheet, row, col, value (text)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coverscope.functions.columns import to_number
from coverscope.operators.bins import prefix_scan
from coverscope.operators.joins import ContractError
from coverscope.operators.scratch import cut
from coverscope.operators.stats import partitions_equivalent


def detect_code_column(cells: DataFrame, pattern: str, at_least: int = 100) -> DataFrame:
    """sheet, code_column (with most cells that match, the first of equals), hits and first_row of the data."""
    hits = cells.where(F.col("value").rlike(pattern)).groupBy("sheet", "col").agg(F.count("*").alias("hits"), F.min("row").alias("first_row")).where(F.col("hits") >= at_least)
    best = hits.groupBy("sheet").agg(F.min_by(F.struct("col", "hits", "first_row"), F.struct(-F.col("hits"), "col")).alias("b"))
    return best.select("sheet", F.col("b.col").alias("code_column"), F.col("b.hits").alias("hits"), F.col("b.first_row").alias("first_row"))


def header_token(c):
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def resolve_header_tokens(headers: DataFrame, tokens: DataFrame) -> DataFrame:
    """token and col of tokens that stand in exactly one header column; anything else is an error. tokens: a small table with the column token."""
    named = headers.select("col", header_token(F.col("value")).alias("token"))
    found = tokens.select(header_token(F.col("token")).alias("token")).join(named, "token", "left").groupBy("token").agg(F.count_distinct("col").alias("n"), F.min("col").alias("col"))
    bad = [r["token"] for r in found.where("n <> 1").collect()]
    if bad:
        raise ContractError(f"header tokens without exactly one column: {bad}")
    return found.select("token", "col")


def fill_right(headers: DataFrame) -> DataFrame:
    """headers with `filled`: the cell's own text, or else the last one left of it in its row; null before the first."""
    rows = headers.withColumn("_text", F.nullif(F.trim("value"), F.lit("")))
    return prefix_scan(rows, ["col"], {"filled": ("last", "_text")}, ["sheet", "row"]).drop("_text")


def merge_headers(headers: DataFrame) -> DataFrame:
    """sheet, col and label: each header row filled to the right, the distinct labels of a column joined with ' | '."""
    filled = fill_right(headers).select("sheet", "row", "col", F.col("filled").alias("value")).where("value is not null")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("row", "value"))), lambda x: x["value"])
    return filled.groupBy("sheet", "col").agg(F.array_join(F.array_distinct(parts), " | ").alias("label"))


def select_covered_columns(cells: DataFrame, labels: DataFrame, pattern: str, more_than: int) -> DataFrame:
    """sheet, col, label and n of the columns whose label matches and which have more numbers than a bound."""
    numbers = cells.where(to_number(F.col("value")).isNotNull()).groupBy("sheet", "col").agg(F.count("*").alias("n"))
    return labels.where(F.col("label").rlike(pattern)).join(numbers, ["sheet", "col"]).where(F.col("n") > more_than)


def resolve_readout(tables: dict[str, DataFrame], pattern: str, min_coverage: float = 0.9, min_distinct: int = 2, low: float | None = None, high: float | None = None, mean_low: float | None = None, mean_high: float | None = None, integer: bool = False) -> DataFrame:
    """source, column, score and profile of the candidates, best first by the order of `tables`, then score, then name; one pass over each table.

    A candidate is a numeric column whose name matches; it must be covered, vary, keep to the
    range, have its mean in the band and, if `integer` asks so, hold whole numbers alone. Several
    best ones of one table and score must part its rows alike, or it is an error."""
    out = None
    for priority, (name, df) in enumerate(tables.items()):
        columns = [c for c, kind in df.dtypes if kind in ("double", "float", "int", "bigint") and re.search(pattern, c)]
        if not columns:
            continue
        whole = lambda c: F.coalesce(F.every(F.abs(F.col(c) - F.round(c)) < 1e-8), F.lit(True))
        profile = lambda c: [F.avg(F.col(c).isNotNull().cast("double")).alias("coverage"), F.count_distinct(c).alias("n_distinct"), F.min(F.col(c).cast("double")).alias("lo"), F.max(F.col(c).cast("double")).alias("hi"), F.avg(c).alias("mean"), whole(c).alias("integer_like")]
        stats = [F.struct(F.lit(c).alias("column"), *profile(c)) for c in columns]
        rows = df.agg(F.array(*stats).alias("r")).select(F.lit(priority).alias("priority"), F.lit(name).alias("source"), F.inline("r"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ContractError(f"no numeric column matches {pattern}")
    fits = (F.col("coverage") >= min_coverage) & (F.col("n_distinct") >= min_distinct)
    for bound, test in ((low, F.col("lo") >= F.lit(low)), (high, F.col("hi") <= F.lit(high)), (mean_low, F.col("mean") >= F.lit(mean_low)), (mean_high, F.col("mean") <= F.lit(mean_high)), (integer or None, F.col("integer_like"))):
        if bound is not None:
            fits = fits & test
    score = F.when(F.col("column").rlike(f"^(?:{pattern})$"), 2).otherwise(1)
    ranked = cut(out.where(fits).withColumn("score", score).withColumn("rank", F.row_number().over(Window.orderBy("priority", F.desc("score"), "source", "column"))))  # a row for each candidate column
    best = ranked.where("rank = 1").first()
    if best:
        rivals = ranked.where((F.col("priority") == best["priority"]) & (F.col("score") == best["score"]) & (F.col("rank") > 1)).collect()
        for r in rivals:
            if not partitions_equivalent(tables[best["source"]], best["column"], r["column"]).first()["equivalent"]:
                raise ContractError(f"{best['column']} and {r['column']} of {best['source']} part the rows differently")
    return ranked
