"""From raw documents to token ids: quality, near-duplicates, benchmark leaks, personal data, pieces.

Each stage takes (spark, docs, sf_dir) and gives back documents in the columns of the
table documents (the last one: token ids in place of the text). Stages handle nulls, empty
texts, ties and repeated rows as their operators say; a table without rows stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverscope.llm import decontaminate, pii, quality_classifier, sentencepiece_codec, simhash
from coverscope.llm.queries import PIECES, pii_key
from coverscope.llm.shared import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, learnt from the labelled ones, predicts as bad."""
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.classify(docs, model).where("quality_predicted = 1").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, a similarity of 0.8 or more) stays, that with the smallest id."""
    return simhash.deduplicated(docs, size=5, similarity=0.8)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes pseudonyms; n_chars follows the new text."""
    return pii.pseudonymise(docs, pii_key(spark)).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and token_ids."""
    ids = sentencepiece_codec.encode(docs, PIECES)
    return ids.select("doc_id", "lang", "source", F.coalesce(F.size("token_ids"), F.lit(0)).alias("n_tokens"), "token_ids")


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminated),
    ("pii", private),
    ("sentencepiece", encoded),
]
#: The classifier and the codec can't be put in SQL: tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
