"""Cross-document line frequency and the rules that go with it, in DataFrame functions only.

A line is normalised (lower case, digits to 0, white space to one space, trimmed) and
hashed. Its frequency on a host is the number of distinct documents of that host with
it. Lines above max(min_docs, share of the host's documents) are boilerplate: they go
from every document, and a document that keeps less than min_kept of its words is
rejected. A document is a distinct (id, host, text): equal rows count once.

Nulls: a null text has no words (and so fails the base rules); null hosts form one host
and null ids are kept. Ties don't matter, as counts are exact. An empty table gives an
empty result. Columns of the input other than the three named ones are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverscope.llm.shared import BLANK, let, words

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8


def repeated_words(hashes: Column) -> Column:
    """Words that stand in a window whose hash occurs twice or more; hashes: of each window, in order."""
    marked = let(
        F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        lambda s: F.sort_array(
            F.filter(
                F.transform(
                    s,
                    lambda e, k: F.when(
                        F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.when(k > 0, F.get(s, k - 1)["h"] == e["h"]), F.lit(False)),
                        e["i"],
                    ),
                ),
                lambda p: p.isNotNull(),
            )
        ),
    )
    reach = let(marked, lambda p: F.transform(p, lambda x, k: F.coalesce(F.least(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))))
    return F.aggregate(reach, F.lit(0).cast("int"), lambda a, x: a + x)


def word_rules(docs: DataFrame, text: str) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    windows = F.when(
        F.size("_words") > WINDOW,
        F.transform(F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("_words"), i, F.lit(WINDOW)))),
    ).otherwise(F.array().cast("array<bigint>"))
    return (
        docs.withColumn("_words", words(F.col(text)))
        .withColumn("_lines", lines)
        .withColumn("_windows", windows)
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn(
            "n_repeat_words",
            F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), repeated_words(F.col("_windows"))).otherwise(F.lit(0)).cast("long"),
        )
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
        .drop("_words", "_lines", "_windows")
    )


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, BLANK + "+", " "), "[0-9]", "0")))


def host_lines(docs: DataFrame, text: str, host: str) -> DataFrame:
    """_key, _host, pos, line_hash and line_words of every line with a word."""
    lines = F.transform(
        F.split(F.coalesce(F.col(text), F.lit("")), "\n"),
        lambda x: F.struct(F.xxhash64(normalised(x)).alias("line_hash"), F.size(words(x)).alias("line_words")),
    )
    return (
        docs.select("_key", F.col(host).alias("_host"), F.posexplode(lines).alias("pos", "line"))
        .select("_key", "_host", "pos", "line.*")
        .where("line_words > 0")
    )


def frequent_lines(docs: DataFrame, text: str, host: str, min_docs: int, share: float) -> DataFrame:
    """_host, line_hash and n_docs of the lines above the host's limit."""
    once = host_lines(docs, text, host).groupBy("_host", "line_hash", "_key").agg(F.lit(1).alias("one"))
    per_line = once.groupBy("_host", "line_hash").agg(F.count("*").alias("n_docs"))
    per_host = docs.groupBy(F.col(host).alias("_host"), "_key").agg(F.lit(1).alias("one")).groupBy("_host").agg(F.count("*").alias("host_docs"))
    return (
        per_line.where(F.col("n_docs") > min_docs)
        .join(per_host.withColumnRenamed("_host", "_h"), F.col("_host").eqNullSafe(F.col("_h")))
        .where(F.col("n_docs") > share * F.col("host_docs"))
        .select("_host", "line_hash", "n_docs")
    )


def row_key(*columns: str) -> Column:
    """16 bytes that tell rows apart: nulls are marked, and each value has its length before it, so that no two rows spell the same."""
    spelt = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (F.col(c).cast("string") for c in columns)]
    return F.unhex(F.md5(F.concat(*spelt)))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = 5, share: float = 0.05, min_kept: float = 0.5) -> DataFrame:
    """Each row of docs (id, host, text) with the word rules, n_removed_words, clean_text, depleted and kept."""
    docs = docs.select(doc_id, host, text).withColumn("_key", row_key(doc_id, host, text))
    limits = frequent_lines(docs, text, host, min_docs, share).withColumnRenamed("_host", "_h").withColumnRenamed("line_hash", "_l")
    hits = (
        host_lines(docs, text, host)
        .join(limits, F.col("_host").eqNullSafe(F.col("_h")) & (F.col("line_hash") == F.col("_l")))
        .groupBy("_key", "pos")
        .agg(F.first("line_words").alias("line_words"), F.first("line_hash").alias("line_hash"))
        .groupBy("_key")
        .agg(F.sum("line_words").alias("n_removed_words"), F.collect_set("line_hash").alias("_frequent"))
    )
    stays = F.filter(F.split(F.col(text), "\n"), lambda x: ~F.array_contains(F.col("_frequent"), F.xxhash64(normalised(x))))
    return (
        word_rules(docs, text)
        .join(hits, "_key", "left")
        .withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
        .withColumn("clean_text", F.when(F.col("_frequent").isNull(), F.col(text)).otherwise(F.array_join(stays, "\n")))
        .withColumn("depleted", F.col("n_words") - F.col("n_removed_words") < min_kept * F.col("n_words"))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
        .drop("_key", "_frequent")
    )
