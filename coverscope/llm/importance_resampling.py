"""Importance resampling towards a target: hashed word n-grams found by one overlapped regex scan.

Separators become single spaces; then, for each length k, a pattern of k words between
boundary lookarounds is searched with overlapped matches, so that every run of k words is
one span of the same bytes, and its CRC-32 is taken straight from the span. A bucket's gain
is the log ratio of its share in the target and in the documents (add-one), a document's
weight the sum of its gains, and its score the weight plus Gumbel noise that depends on
its id and the seed alone: the highest scores are a draw without replacement in proportion
to exp(weight / 1000).

What travels: each task adds up its buckets before the shuffle, the driver gets one number
for each bucket (`buckets`, a parameter), and the gains go back to the tasks. Ranks come
from range partitions with offsets; no task sorts or holds all documents.

Nulls: a null text has no words and no features (weight 0). A null id counts as the text
'' for the noise and comes last among ties. Ties go to the smaller id, then to the smaller
number of features and weight. Repeated rows are documents of their own. An empty table
gives an empty result; an empty target gives gains from its add-one shares. Other columns
of the input are not used, so their names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverscope.llm.shared import written

#: Bytes of a text: A-Z to lower case, separators to spaces; digits, letters and all bytes of other characters stay.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Features handled at once, whatever a text's length.
BLOCK = 1 << 20


def collapsed(text: bytes) -> bytes:
    """Lower-cased words between single spaces."""
    return b" ".join(text.translate(PLAIN).split())


def scanners(n: int) -> list[regex.Pattern]:
    """For each length up to n a pattern whose overlapped matches are all runs of so many words."""
    return [regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % (k - 1)) for k in range(1, n + 1)]


def spans(text: bytes, patterns: Iterable[regex.Pattern]) -> Iterator[tuple[int, int]]:
    """Where the n-grams of a collapsed text stand in it."""
    for pattern in patterns:
        for found in pattern.finditer(text, overlapped=True):
            yield found.span()


def bucket_blocks(text: bytes, patterns: list[regex.Pattern], buckets: int) -> Iterator[np.ndarray]:
    """The buckets of a text's features, block by block."""
    plain = collapsed(text)
    view = memoryview(plain)
    sums = (crc32(view[start:end]) for start, end in spans(plain, patterns))
    while len(block := np.fromiter(islice(sums, BLOCK), np.int64)):
        yield block % buckets


def bucket_counts(docs: DataFrame, text: str = "text", n: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, total = scanners(n), np.zeros(buckets, np.int64)
        held, size = [], 0
        for batch in batches:
            for value in batch.column(0):
                for block in bucket_blocks(value.as_py() or b"", patterns, buckets):
                    held.append(block)
                    size += len(block)
                    if size >= BLOCK:
                        total += np.bincount(np.concatenate(held), minlength=buckets)
                        held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(total[full], pa.int64())], names=["bucket", "n"])

    rows = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for row in rows:  # a row for each bucket at most
        out[row["bucket"]] = row["n"]
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's add-one shares, rounded down."""
    size, every, wanted = float(len(source)), float(source.sum()), float(target.sum())
    ratio = (target + 1.0) * (every + size) / ((source + 1.0) * (wanted + size))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", n: int = 1) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    buckets = len(gain)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = scanners(n)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                raw = value.as_py() or b""
                blocks = [(len(b), int(gain[b].sum())) for b in bucket_blocks(raw, patterns, buckets)]
                features = sum(b[0] for b in blocks)
                rows.append((features if n == 1 else len(raw.translate(PLAIN).split()), features, sum(b[1] for b in blocks)))
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([], [], []))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(add, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of standard Gumbel noise, rounded down, from the first 32 bits of SHA-256 of 'seed:id'."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(share)))


def drawn(scored: DataFrame, share: int, min_words: int) -> DataFrame:
    """scored (doc_id, n_words, n_features, weight, score) with the rank of the drawn rows: share percent of those with min_words words or more."""
    can = scored.where(F.col("n_words") >= min_words)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc()]
    place = F.monotonically_increasing_id()  # the partition, then the row's number in it
    placed = written(can.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.shiftright(place, 33)).withColumn("_row", place.bitwiseAND((1 << 33) - 1)), "resampling-placed")
    sizes = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())  # a row for each partition
    before, every = {}, 0
    for part, size in sizes:
        before[part] = every
        every += size
    take = every * share // 100
    offsets = scored.sparkSession.createDataFrame([(p, b) for p, b in before.items()], "_part bigint, _before bigint")
    rank = F.col("_before") + F.col("_row") + 1
    ranked = placed.join(F.broadcast(offsets), "_part").withColumn("rank", F.when(rank <= take, rank)).select(*scored.columns, "rank")
    return ranked.unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("bigint")))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", n: int = 1, buckets: int = 10_000, seed: int = 2024, share: int = 10, min_words: int = 20) -> DataFrame:
    """Every row's doc_id, n_words, n_features, weight, score and rank (null where it is not drawn)."""
    gain = gains(bucket_counts(target, target_text, n, buckets), bucket_counts(docs, text, n, buckets))
    weighed = weigh(docs, gain, doc_id, text, n).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return drawn(written(weighed, "resampling-scored"), share, min_words)
