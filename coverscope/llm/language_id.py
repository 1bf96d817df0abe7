"""Language-bitmask n-gram filters.

Learning counts the letter n-grams of every language over all its documents and keeps, of
each language, those that make up at least `rate` of its n-grams and at least `relative`
of the highest rate that any language has (documents quote other languages). There are at
most 1/rate of them for a language and size, whatever the corpus. A bit-sliced Bloom
filter holds them: a row of bits for each hash place, a bit for each language, so that the
AND of a few rows gives all languages that contain an n-gram. A text's votes for a
language are its n-grams with that language's bit, less those expected by chance from the
filter's false positives.

`und` with score 0: null texts and texts without a letter, and all texts if nothing could
be learned. A text with letters of which no n-gram is known gets the language with most
training documents and score 0. Ties go to the language first by name. Documents with a
null lang teach nothing. Repeated rows count as often as they stand. Columns named lang_pred
and lang_score give way to the result's.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverscope.llm.shared import schema_of, written

SIZES = (3, 4)
LETTER = re.compile(r"[^\W\d_]")
#: ASCII bytes that aren't letters become spaces; others stay.
SPACED = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def spelt(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(SPACED).split()


def word_grams(distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of words with a space on either side, as numbers, and the index of the word that each is of."""
    b = np.frombuffer(b" " + b" ".join(distinct) + b" ", np.uint8).astype(np.uint64)
    blank = b == 32
    word = np.cumsum(blank) - 1
    grams, owner = [], []
    for n in SIZES:
        if len(b) < n:
            continue
        value, inside = np.zeros(len(b) - n + 1, np.uint64), np.ones(len(b) - n + 1, bool)
        for i in range(n):
            value = (value << np.uint64(8)) | b[i : len(b) - n + 1 + i]
            if 0 < i < n - 1:
                inside &= ~blank[i : len(b) - n + 1 + i]
        grams.append(value[inside] | np.uint64(n << 40))
        owner.append(word[: len(value)][inside])  # a gram that starts with a space is of the word after it
    return (np.concatenate(grams), np.concatenate(owner)) if grams else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen: dict[str, Counter] = defaultdict(Counter)
        for text, lang in zip(b["text"].to_pylist(), b["lang"].to_pylist(), strict=True):
            seen[lang].update(spelt(text or ""))
        for lang, found in seen.items():
            grams, owner = word_grams(list(found))
            if len(grams):
                distinct, at = np.unique(grams, return_inverse=True)
                n = np.bincount(at, weights=np.fromiter(found.values(), float)[owner])
                yield pa.record_batch({"lang": pa.array([lang] * len(distinct)), "gram": pa.array(distinct.astype(np.int64)), "n": pa.array(n.astype(np.int64))})


def _rows(gram: np.ndarray, k: int, size: int) -> list[np.ndarray]:
    """k places of each n-gram in a table of size (a power of two) rows."""
    with np.errstate(over="ignore"):
        h = gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        step = (h >> np.uint64(32)) | np.uint64(1)
        return [((h + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64) for i in range(k)]


@dataclass
class Filters:
    langs: list[str]  # by name
    tables: list[np.ndarray]  # of 64 languages each
    chance: np.ndarray  # of each language: of a false positive
    usual: int  # the language with most documents
    k: int

    def votes(self, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each word: hits in each language, and n-grams."""
        grams, owner = word_grams(distinct)
        hits = np.zeros((len(distinct), len(self.langs)))
        for t, table in enumerate(self.tables):
            mask = np.full(len(grams), ~np.uint64(0))
            for rows in _rows(grams, self.k, len(table)):
                mask &= table[rows]
            for i in range(min(64, len(self.langs) - 64 * t)):
                hits[:, 64 * t + i] = np.bincount(owner[(mask >> np.uint64(i)) & np.uint64(1) == 1], minlength=len(distinct))
        return hits, np.bincount(owner, minlength=len(distinct))

    def decide(self, hits: np.ndarray, n: float) -> tuple[str, float]:
        fair = np.maximum(hits - n * self.chance, 0) / (1 - self.chance)
        best = int(np.argmax(fair))
        return (self.langs[best], float(min(fair[best] / fair.sum(), 1.0))) if fair[best] > 0 else (self.langs[self.usual], 0.0)


def learn(docs: DataFrame, rate: float = 2e-5, relative: float = 0.2, k: int = 3, bits_per_gram: int = 16) -> Filters | None:
    """docs: text and lang. None if there is no language to learn."""
    docs = docs.where("lang is not null").select("text", "lang")
    counts = docs.mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = written(counts, "grams")  # it is read three times
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total")).where(F.col("rate") >= rate)
    top = rated.groupBy("gram").agg(F.max("rate").alias("top"))
    kept = rated.join(top, "gram").where(F.col("rate") >= relative * F.col("top")).select("lang", "gram").toPandas()
    sizes = docs.groupBy("lang").count().toPandas()
    langs = sorted(sizes.lang)
    if not langs:
        return None
    size = 1 << int(np.ceil(np.log2(max(bits_per_gram * kept.groupby("lang").size().max(), 1024)))) if len(kept) else 1024
    tables = [np.zeros(size, np.uint64) for _ in range(-(-len(langs) // 64))]
    for lang, own in kept.groupby("lang"):
        i = langs.index(lang)
        for rows in _rows(own.gram.to_numpy(np.uint64), k, size):
            np.bitwise_or.at(tables[i // 64], rows, np.uint64(1 << i % 64))
    fill = np.array([((tables[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))])
    usual = langs.index(sizes.sort_values(["count", "lang"], ascending=[False, True]).lang.iloc[0])
    return Filters(langs, tables, np.minimum(fill**k, 0.99), usual, k)


def predict(docs: DataFrame, filters: Filters | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and lang_score."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # bounded: see the module's text

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            index: dict[bytes, int] = {}
            own = []
            for t in b[text].to_pylist():
                known = f is not None and t is not None and LETTER.search(t)
                own.append(np.array([index.setdefault(w, len(index)) for w in spelt(t)], np.int64) if known else None)
            hits, n = f.votes(list(index)) if f is not None else (None, None)
            said = [("und", 0.0) if x is None else f.decide(hits[x].sum(axis=0), n[x].sum()) for x in own]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())], [*b.schema.names, "lang_pred", "lang_score"])

    kept = docs.drop("lang_pred", "lang_score")
    return kept.mapInArrow(guess, f"{schema_of(kept)}, lang_pred string, lang_score double")
