"""The queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverscope.llm import decontaminate, filter_audit, fingerprints, html_extract, importance_resampling, language_id, lm_trie, pii, quality_classifier, quality_rules, sentencepiece_codec, simhash, substring_dedup
from coverscope.llm.shared import crc_remainder, table


def pii_key(spark: SparkSession) -> str:
    """The secret key of the session (spark.coverscope.pii.key). Without one a key for demonstration, which protects nothing."""
    return spark.conf.get("spark.coverscope.pii.key", "demonstration")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))
    return docs.select("doc_id", "text", F.size("pii").alias("n_found"), F.array_join("pii.kind", ",").alias("kinds"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words"
    )


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.classify(docs, model).select(
        "doc_id",
        (crc_remainder(F.col("doc_id"), 3) == 1).alias("held_out"),
        F.col("quality_score").alias("score"),
        F.col("quality_predicted").alias("predicted"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = language_id.learn(docs.where(crc_remainder(F.col("doc_id"), 4) != 2))
    return language_id.predict(docs.select("doc_id", "text"), filters).select(
        "doc_id", (crc_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


#: A public merge model with byte pieces; any other model file can be given instead.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by shared-prefix Viterbi. PIECES is a model of merges: its forward states are told by agreement, not by sums of scores (see the operator)."""
    docs = sentencepiece_codec.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES)
    return docs.select(
        "doc_id",
        F.coalesce(F.size("token_ids"), F.lit(0)).alias("n_tokens"),
        "token_ids",
        F.col("decoded_text").eqNullSafe(F.translate("text", "▁", " ")).alias("round_trip"),
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_remainder(F.col("doc_id"), 7) == 2
    model = lm_trie.train(docs.where(~held_out), order=3)
    return lm_trie.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", F.col("lm_score").alias("score")
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fingerprints.edits(table(spark, sf_dir, "documents"))
    return docs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        F.array_join("sketch", "").alias("fingerprint"),
        F.array_join("edited_sketch", "").alias("edited_fingerprint"),
        fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprints.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_pii": op5_pii,
    "op6_language_id": op6_language_id,
    "op7_decontaminate": op7_decontaminate,
    "op8_lm_score": op8_lm_score,
    "op9_simhash": op9_simhash,
    "op10_quality_rules": op10_quality_rules,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_filter_audit": op12_filter_audit,
    "op13_fingerprints": op13_fingerprints,
}

ORACLE = {
    "op10_quality_rules": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, text FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, source, text, i, array_to_string(ws[i : i + 7], ' ') AS g
        FROM w, unnest(generate_series(1, len(ws) - 7)) AS u(i)),
rep AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, source, text, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, source, text, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id, source, text ORDER BY i) - i, 8)) AS r FROM rep),
rw AS (SELECT doc_id, source, text, sum(r)::BIGINT AS n_repeat_words FROM cov GROUP BY ALL),
ln AS (SELECT doc_id, source, text,
              lower(trim(regexp_replace(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g'))) AS l,
              len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS lw
       FROM (SELECT doc_id, source, text, unnest(ls) AS x FROM w)),
per_host AS (SELECT source, count(DISTINCT (doc_id, text)) AS host_docs FROM d GROUP BY source),
freq AS (SELECT source, l FROM (SELECT source, l, count(DISTINCT (doc_id, text)) AS n FROM ln GROUP BY ALL) JOIN per_host USING (source)
         WHERE n > 5 AND n > 0.05 * host_docs),
gone AS (SELECT doc_id, source, text, sum(lw)::BIGINT AS n_removed_words FROM ln JOIN freq USING (source, l) GROUP BY ALL),
base AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
                coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
                coalesce(n_removed_words, 0)::BIGINT AS n_removed_words
         FROM w LEFT JOIN rw USING (doc_id, source, text) LEFT JOIN gone USING (doc_id, source, text))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_removed_words >= 0.5 * n_words AS kept,
       n_removed_words
FROM base""",
    # CRC-32 by its definition, over the bytes of each distinct word
    "op11_importance_resampling": r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
goal AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
doc_words AS (SELECT doc_id, unnest(ws) AS w FROM docs),
goal_words AS (SELECT unnest(ws) AS w FROM goal),
crc_table AS (SELECT list(list_reduce(range(0, 8), lambda c, bit: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t FROM range(0, 256) r(i)),
each_word AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM doc_words UNION SELECT w FROM goal_words)),
hashed AS (SELECT w, xor(list_reduce(list_transform(range(1, length(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT), lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM each_word, crc_table),
s AS (SELECT bucket, count(*) AS n FROM doc_words JOIN hashed USING (w) GROUP BY ALL),
t AS (SELECT bucket, count(*) AS n FROM goal_words JOIN hashed USING (w) GROUP BY ALL),
gain AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS g FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT doc_id, sum(g)::BIGINT AS weight FROM doc_words JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= n * 10 // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)""",
    # every document walked through every order, without the lattice
    "op12_filter_audit": r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (SELECT part, {'A': len(ws) < 100, 'B': 100 * len(list_distinct(ws)) < 80 * len(ws), 'C': 100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 10 * length(x),
  'D': regexp_matches(x, '[#$%&*|]'), 'E': doc_id > min(doc_id) OVER (PARTITION BY x)} AS fails, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM t LEFT JOIN labels USING (doc_id)),
d AS (SELECT part, row_number() OVER () AS id, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda c: CASE c WHEN 'A' THEN fails.A WHEN 'B' THEN fails.B WHEN 'C' THEN fails.C WHEN 'D' THEN fails.D ELSE coalesce(fails.E, false) END) AS fl FROM f),
orders(o) AS (SELECT '' UNION ALL SELECT o || c FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(c) WHERE NOT contains(o, c)),
steps AS (SELECT o, i AS step, o[i] AS c FROM orders, range(1, 6) r(i) WHERE length(o) = 5),
x AS (SELECT part, o, step, c, list_contains(fl, c) AS bad, len(list_filter(fl, lambda k: strpos(o, k) < step)) AS earlier, len(fl) AS nf, good, toxic FROM d, steps),
r AS (SELECT part, o, step, c, count(*) FILTER (earlier = 0 AND NOT bad) AS kept, count(*) FILTER (earlier = 0 AND bad) AS removed, count(*) FILTER (earlier > 0 AND bad) AS redundant,
  count(*) FILTER (bad AND nf = 1) AS unique_fails, count(*) FILTER (earlier = 0 AND bad AND good) AS good_lost, count(*) FILTER (earlier = 0 AND bad AND toxic) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, o AS filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley FROM r""",
    "op13_fingerprints": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, '')) AS n FROM documents),
nx AS (SELECT doc_id, x, n, coalesce(lead(x) OVER o, first_value(x) OVER o) AS y FROM t WINDOW o AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT doc_id, n, x, y, substr(x, 1, n - n // 3) || substr(y, 1, n // 3) AS z FROM nx),
ws AS (SELECT doc_id, side, regexp_extract_all(v, '[^\x20\x09-\x0D]+') AS w FROM (SELECT doc_id, unnest(['x', 'y', 'z']) AS side, unnest([x, y, z]) AS v FROM e)),
sk AS (SELECT doc_id, side, list_sort(list_distinct(list_transform(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END, lambda s: substr(md5(s), 1, 16))))[1 : 128] AS k FROM ws),
p AS (SELECT doc_id, any_value(k) FILTER (side = 'x') AS a, any_value(k) FILTER (side = 'y') AS b, any_value(k) FILTER (side = 'z') AS c FROM sk GROUP BY doc_id),
u AS (SELECT *, list_sort(list_distinct(a || c))[1 : 128] AS ac, list_sort(list_distinct(a || b))[1 : 128] AS ab FROM p)
SELECT doc_id, n AS n_chars, sha256(z) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(c, '') AS edited_fingerprint,
  CASE WHEN len(ac) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(ac, lambda h: list_contains(a, h) AND list_contains(c, h)))::DOUBLE / len(ac) END AS near_edited,
  CASE WHEN len(ab) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(ab, lambda h: list_contains(a, h) AND list_contains(b, h)))::DOUBLE / len(ab) END AS near_next
FROM e JOIN u USING (doc_id)""",
}
