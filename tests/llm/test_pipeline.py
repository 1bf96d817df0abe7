"""The pipeline's stages against plain versions on the smallest tables, and the queries' SQL."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from coverscope.llm import decontaminate, quality_classifier

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def test_line_rules_match_sql(spark, compare):
    compare(entry.queries()["op10_quality_rules"](spark, SF), entry.oracle_sql()["op10_quality_rules"], SF)


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = entry.queries()["op4_quality_classifier"](spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.9 * len(got)
    lang = entry.queries()["op6_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in lang) >= 0.95 * len(lang)


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.quality(spark, docs, SF).cache()
    assert kept.columns == columns
    model = quality_classifier.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    import numpy as np

    mark = np.zeros(1 << quality_classifier.BITS, bool)
    want = {r.doc_id for r in docs.collect() if model.score(quality_classifier.grams(r.text, mark)) >= 0.5}
    assert {r.doc_id for r in kept.collect()} == want

    once = corpus_pipeline.near_dedup(spark, kept, SF).cache()
    rows = sorted(kept.collect(), key=lambda r: r.doc_id)
    runs = [(w := (r.text or "").encode().lower().split()) and {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if runs[i] == runs[j] or runs[i] and runs[j] and len(runs[i] & runs[j]) >= 0.8 * len(runs[i] | runs[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    assert {r.doc_id for r in once.collect()} == {rows[g].doc_id for g in group} and once.columns == columns

    clean = corpus_pipeline.decontaminated(spark, once, SF).cache()
    items = [decontaminate.plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r.doc_id for r in once.collect() if not any(i in decontaminate.plain(r.text) for i in items)}
    assert {r.doc_id for r in clean.collect()} == left and clean.columns == columns

    private = corpus_pipeline.private(spark, clean, SF).cache()
    assert private.columns == columns and private.count() == clean.count()
    assert all(r.n_chars == len(r.text) for r in private.collect())
    import sentencepiece

    from coverscope.llm.queries import PIECES

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    text = {r.doc_id: r.text for r in private.collect()}
    assert all(r.token_ids == library.encode(text[r.doc_id]) and r.n_tokens == len(r.token_ids) for r in corpus_pipeline.encoded(spark, private, SF).collect())


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
