"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A text's shingles are its runs of five words (fewer words: the whole sequence; none: no
shingle), hashed to the first 64 bits of MD5 as 16 hex digits; its sketch is the array of the
k smallest distinct hashes in order. The k smallest of a union are among the k smallest of
its parts, so sketches of parts merge without their texts. From two sketches follow
resemblance (the share of the k smallest of the union that both have), containment and the
number of distinct shingles (exact below k).

Merging by a key keeps k rows of each task and key before the shuffle (a row number's limit),
so a hot key never gathers more than tasks x k hashes in one task.

Nulls: a null text is the empty text; a null sketch counts as one without hashes. Two sketches
without hashes resemble each other fully (1), one without and one with not at all (0), and
the empty set is contained in any. Equal texts have equal sketches. Repeated rows are kept.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverscope.llm.shared import let, words, written

DIGITS = 16
SPACE = float(1 << 64)


def no_hashes() -> Column:
    return F.array().cast("array<string>")


def shingle_hashes(text: Column, size: int = 5) -> Column:
    """The hash of every shingle, in order."""
    short = lambda s: F.substring(F.md5(s.cast("binary")), 1, DIGITS)
    run = lambda w, i: F.concat(F.get(w, i), *[c for j in range(1, size) for c in (F.lit(" "), F.get(w, i + j))])  # noqa: E731  null where fewer words are left
    runs = lambda w: F.slice(F.transform(w, lambda _, i: short(run(w, i))), F.lit(1), F.size(w) - (size - 1))
    return let(words(text), lambda w: F.when(F.size(w) >= size, runs(w)).when(F.size(w) > 0, F.array(short(F.array_join(w, " ")))).otherwise(no_hashes()))


def bottom(hashes: Column, k: int) -> Column:
    """The k smallest distinct hashes, in order."""
    return F.slice(F.sort_array(F.array_distinct(F.coalesce(hashes, no_hashes()))), 1, k)


def sketch(text: Column, k: int = 128, size: int = 5) -> Column:
    return bottom(shingle_hashes(text, size), k)


def union(a: Column, b: Column, k: int = 128) -> Column:
    """The sketch of both parts together."""
    return bottom(F.concat(F.coalesce(a, no_hashes()), F.coalesce(b, no_hashes())), k)


def resemblance(a: Column, b: Column, k: int = 128) -> Column:
    """The estimated share of common shingles in all of both, 0 to 1."""
    a, b = F.coalesce(a, no_hashes()), F.coalesce(b, no_hashes())
    among = lambda u: F.size(F.filter(F.array_intersect(a, b), lambda h: h <= F.element_at(u, -1)))
    return let(union(a, b, k), lambda u: F.when(F.size(u) == 0, 1.0).otherwise(among(u).cast("double") / F.size(u)))


def distinct_shingles(sketched: Column, k: int = 128) -> Column:
    """The estimated number of distinct shingles; exact where the sketch has fewer than k hashes."""
    last = F.element_at(sketched, -1)
    half = lambda at: F.conv(F.substring(last, at, 8), 16, 10).cast("double")
    highest = (half(1) * 4294967296.0 + half(9) + 1) / SPACE
    return F.when(F.coalesce(F.size(sketched), F.lit(0)) < k, F.coalesce(F.greatest(F.size(sketched), F.lit(0)), F.lit(0)).cast("double")).otherwise((k - 1) / highest)


def containment(a: Column, b: Column, k: int = 128) -> Column:
    """The estimated share of a's shingles that b has, 0 to 1."""
    common = resemblance(a, b, k) * distinct_shingles(union(a, b, k), k)
    return F.when(F.coalesce(F.size(a), F.lit(0)) <= 0, 1.0).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def merged(sketches: DataFrame, keys: Sequence[str], column: str = "sketch", k: int = 128) -> DataFrame:
    """keys and the sketch of all rows of each key together (keys whose rows have no hash: an empty one)."""
    keys = list(keys)
    hashes = sketches.select(*keys, F.explode_outer(column).alias("_hash")).distinct()
    smallest = hashes.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_hash").asc_nulls_last()))).where(F.col("_n") <= k)
    return smallest.groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias(column))


def next_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, to_id and third: each id that is the next one (descending, after the last the first) of to_id, and a third of the longest text of to_id, in code points.

    Ids and lengths alone are range-partitioned and placed, then joined by place; no text is moved and no task holds all ids."""
    ids = docs.groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.coalesce(F.length(text), F.lit(0))).alias("n"))
    order = F.col("doc_id").desc_nulls_last()
    at = F.monotonically_increasing_id()  # the partition, then the row's number in it
    placed = written(ids.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.shiftright(at, 33)).withColumn("_row", at.bitwiseAND((1 << 33) - 1)), "fingerprint-ids")
    sizes = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())  # a row for each partition
    before, every = [], 0
    for part, size in sizes:
        before.append((part, every))
        every += size
    offsets = docs.sparkSession.createDataFrame(before, "_part bigint, _before bigint")
    ranked = placed.join(F.broadcast(offsets), "_part").select("doc_id", "n", (F.col("_before") + F.col("_row")).alias("_place"))
    own = ranked.select("doc_id", F.pmod(F.col("_place") - 1, F.lit(max(every, 1))).alias("_before_it"))
    return own.join(ranked.select(F.col("doc_id").alias("to_id"), F.floor(F.col("n") / 3).cast("int").alias("third"), "_place"), F.col("_before_it") == F.col("_place")).select("doc_id", "to_id", "third")


def packed(sketched: Column) -> Column:
    """A sketch as bytes, eight for each hash."""
    return F.unhex(F.array_join(sketched, ""))


def unpacked(packed_sketch: Column) -> Column:
    n = (F.coalesce(F.octet_length(packed_sketch), F.lit(0)) / 8).cast("int")
    digits = F.lower(F.hex(packed_sketch))
    return F.when(n > 0, let(digits, lambda d: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(d, i * DIGITS + 1, F.lit(DIGITS))))).otherwise(no_hashes())


def edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 128, size: int = 5) -> DataFrame:
    """doc_id, text, edited_text, sketch, edited_sketch and next_sketch of every row.

    The edited text has the text's last third (code points, rounded down) replaced by as many first ones, or all, of the next
    document. Of several rows with one id that of the least MD5 stands for it as a next document. Both joins use one shuffle of
    the texts, by id; what a document hands on to the one before it is a third of that one's length and a sketch."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))  # noqa: E731  never null, so that all steps use one partitioning
    rows = docs.select(F.col(doc_id).alias("doc_id"), key(doc_id).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    links = next_documents(rows).select(key("doc_id").alias("_key"), key("to_id").alias("_to"), "third")
    given = (
        rows.join(links, "_key")
        .select(F.col("_to").alias("_key"), F.struct(F.md5(F.col("text").cast("binary")).alias("md5"), F.expr("left(text, third)").alias("head"), packed(sketch(F.col("text"), k, size)).alias("sketch"), "doc_id").alias("next"))  # the id, so that both joins read the same columns of one shuffle
        .groupBy("_key")
        .agg(F.min("next").alias("next"))
    )
    third = F.floor(F.length("text") / 3).cast("int")
    return (
        rows.join(given, "_key")
        .select("doc_id", "text", F.concat(F.left("text", F.length("text") - third), F.left("next.head", third)).alias("edited_text"), F.col("next.sketch").alias("_next"))
        .withColumns({"sketch": sketch(F.col("text"), k, size), "edited_sketch": sketch(F.col("edited_text"), k, size), "next_sketch": unpacked(F.col("_next"))})
        .drop("_next")
    )
