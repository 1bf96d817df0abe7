"""Importance resampling, filter audit and fingerprints against plain versions, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from coverscope.llm import filter_audit, fingerprints, importance_resampling

SCHEMA = "doc_id bigint, text string, lang string, source string, weight double, rank string, part int, sketch int, _part int, digest string"
LONG = "the cat sat on the mat and " * 20000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, equal texts, and columns with names that operators use."""
    rest = (0.5, "r", 1, 2, 3, "d")
    rows = [
        (1, "One plain line of text. ONE more, with Words in it: twelve words or so.", "en", "a", *rest),
        (1, "One plain line of text. ONE more, with Words in it: twelve words or so.", "en", "a", *rest),
        (2, "", "en", "a", *rest),
        (3, None, None, None, None, None, None, None, None, None),
        (None, "A text without an id", "de", "b", *rest),
        (5, LONG, "en", "a", *rest),
        (6, " \n\t\n 123 ### ", "fr", None, *rest),
        (7, LONG, "", "a", *rest),
        (8, "Ünïcode 漢字   ÀB 9x", "fr", "b", *rest),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def some_texts(n, seed, letters="abcdefg", longest=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 3))) for _ in range(40)]
    return [rng.choice([" ", ", ", "--", "\n"]).join(rng.choice([w, w.upper(), w.title()]) for w in rng.choices(words, k=rng.randint(0, longest))) for _ in range(n)]


# importance resampling


def plain_features(text, n):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain_resample(docs, target, n, buckets, seed, share, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for texts, counts in ((docs, s), (target, t)):
        for row in texts:
            for f in plain_features(row[1], n)[1]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + buckets) / ((a + 1.0) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for doc_id, text in docs:
        words, features = plain_features(text, n)
        weight = sum(gain[bucket(f)] for f in features)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    can = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    place = {id(r): i + 1 for i, r in enumerate(can[: len(can) * share // 100])}
    return [(*r, place.get(id(r))) for r in rows]


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: [(x is None, str(x)) for x in r])


def found(frame):
    return order(frame.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect())


@pytest.mark.parametrize(("n", "buckets"), [(1, 10000), (2, 97), (3, 1000)])
def test_resampling_equals_the_plain_version(spark, n, buckets):
    docs = list(enumerate(some_texts(300, 1)))
    target = list(enumerate(some_texts(20, 2, "abcxyz")))
    frames = [spark.createDataFrame(x, "doc_id bigint, text string") for x in (docs, target)]
    got = importance_resampling.resample(frames[0].repartition(5), frames[1], n=n, buckets=buckets, seed=7, share=25, min_words=5)
    want = plain_resample(docs, target, n, buckets, 7, 25, 5)
    assert found(got) == order(want)
    assert sum(r[5] is not None for r in want) == sum(r[1] >= 5 for r in want) // 4


def test_spans_are_all_runs_of_words():
    text = importance_resampling.collapsed("One two-three, 4 fünf!".encode())
    assert text.decode() == "one two three 4 fünf"
    got = [text[a:b].decode() for a, b in importance_resampling.spans(text, importance_resampling.scanners(2))]
    assert got == ["one", "two", "three", "4", "fünf", "one two", "two three", "three 4", "4 fünf"]


def test_long_texts_go_block_by_block(monkeypatch):
    monkeypatch.setattr(importance_resampling, "BLOCK", 7)
    blocks = list(importance_resampling.bucket_blocks(b"a b c d e f g h i j", importance_resampling.scanners(1), 100))
    assert [len(b) for b in blocks] == [7, 3]
    assert [x for b in blocks for x in b] == [zlib.crc32(c.encode()) % 100 for c in "abcdefghij"]


def test_resampling_of_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    target = [(0, "some words of a text"), (1, None)]
    frame = spark.createDataFrame(target, "item_id bigint, text string")
    assert found(importance_resampling.resample(odd, frame, share=50, min_words=3)) == order(plain_resample(rows, target, 1, 10000, 2024, 50, 3))
    assert importance_resampling.resample(empty, frame).count() == 0
    assert importance_resampling.resample(odd, empty).count() == len(rows)


# filter audit


def plain_audit(rows, labels):
    """rows: (doc_id, text, part); labels: id to (quality, toxic)."""
    parts = {}
    for doc_id, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows),
        }
        parts.setdefault(part or "", []).append(({c for c in fails if fails[c]}, *labels.get(doc_id, (0, 0))))
    out = []
    for part, docs in parts.items():
        removed_by = dict.fromkeys("ABCDE", 0)
        some = []
        for o in permutations("ABCDE"):
            left = docs
            for k, c in enumerate(o):
                gone, left = [d for d in left if c in d[0]], [d for d in left if c not in d[0]]
                removed_by[c] += len(gone)
                failing = sum(c in d[0] for d in docs)
                some.append([part, "".join(o), k + 1, len(left), len(gone), failing - len(gone), sum(d[0] == {c} for d in docs), sum(d[1] == 1 for d in gone), sum(d[2] == 1 for d in gone), c])
        out += [(*r[:-1], removed_by[r[-1]]) for r in some]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_equals_walking_every_order(spark):
    rng = random.Random(3)
    texts = some_texts(40, 4, longest=260)
    rows = [(i, rng.choice(texts) + rng.choice(["", " # ", " | x"]), rng.choice(["en", "de", None, ""])) for i in range(150)]
    labels = {i: (rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 150, 2)}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    said = spark.createDataFrame([(i, *v) for i, v in labels.items()], "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit(docs.repartition(3), said)
    assert sorted(map(tuple, got.select(*COLUMNS).collect())) == plain_audit(rows, labels)


def test_audit_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (5, None, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()]
    got = filter_audit.audit(odd, labels)
    assert sorted(map(tuple, got.select(*COLUMNS).collect())) == plain_audit(rows, {1: (1, 1), 5: (0, 1)})
    assert filter_audit.audit(empty, labels).count() == 0
    assert filter_audit.audit(odd, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_paths_through_the_lattice():
    edges, steps = filter_audit.lattice(4)
    assert len(edges) == 4 * 8 and len(steps) == 24 * 4
    assert all(e["orders"] == sum(s["edge"] == i for s in steps) for i, e in enumerate(edges))


def test_too_many_filters_raise(spark, empty):
    with pytest.raises(ValueError, match="orders"):
        filter_audit.interactions(spark.createDataFrame([], "part string, mask int, good boolean, toxic boolean"), "ABCDEFG")


# fingerprints


def plain_sketch(text, k=128, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    return sorted({hashlib.md5(r.encode()).hexdigest()[:16] for r in runs})[:k]


def plain_likeness(a, b, k=128):
    u = sorted({*a, *b})[:k]
    return len({*u} & {*a} & {*b}) / len(u) if u else 1.0


def plain_edits(rows):
    """rows with distinct ids, nulls last in descending order."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        third = len(t) // 3
        e = t[: len(t) - third] + nxt[:third]
        a, b, c = plain_sketch(t), plain_sketch(e), plain_sketch(nxt)
        out.append((i, e, a, b, round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)))
    return sorted(out, key=str)


def sketched(docs):
    d = fingerprints.edits(docs)
    near = [F.round(fingerprints.resemblance(F.col("sketch"), F.col(c)), 9) for c in ("edited_sketch", "next_sketch")]
    return sorted(map(tuple, d.select("doc_id", "edited_text", "sketch", "edited_sketch", *near).collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 60])
def test_edits_and_sketches_equal_the_plain_version(spark, n):
    rows = [(3 * i, t) for i, t in enumerate(some_texts(n, 9, longest=400))]
    assert sketched(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)) == plain_edits(rows)


def test_fingerprints_of_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    once = [*dict.fromkeys(rows)]
    got = sketched(odd)
    assert len(got) == len(rows)
    assert sorted(dict.fromkeys((x[0], x[1]) for x in got), key=str) == sorted(((x[0], x[1]) for x in plain_edits(once)), key=str)
    assert sorted({str(x) for x in got}) == sorted({str(x) for x in plain_edits(once)})
    assert fingerprints.edits(empty).count() == 0


def test_several_texts_of_one_id(spark):
    rows = [(1, "a b c d e f"), (2, "one two three"), (2, "vier fünf sechs"), (3, "x y z x y z")]
    got = {(r["doc_id"], r["text"]): r["edited_text"] for r in fingerprints.edits(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    first = min(rows[1:3], key=lambda r: hashlib.md5(r[1].encode()).hexdigest())[1]
    assert len(got) == 4 and got[3, "x y z x y z"] == "x y z x " + first[:3] and got[1, "a b c d e f"] == "a b c d x y"


def test_merged_sketches_equal_those_of_the_whole(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), " ".join(rng.choices("uvwxyz", k=rng.randint(0, 80)))) for _ in range(60)] + [("c", ""), (None, "a b c d e f"), (None, None)]
    docs = spark.createDataFrame(rows, "source string, text string").withColumn("sketch", fingerprints.sketch(F.col("text"), k=32))
    got = {r["source"]: r["sketch"] for r in fingerprints.merged(docs, ["source"], k=32).collect()}
    want = {s: sorted({h for x, t in rows if x == s for h in plain_sketch(t, k=10**9)})[:32] for s in ("a", "b", "c", None)}
    assert got == want


def test_estimates_are_near_the_truth(spark):
    rng = random.Random(6)
    a = [str(rng.random()) for _ in range(3000)]
    b = a[:2000] + [str(rng.random()) for _ in range(1000)]
    c = a[:1500]
    row = spark.createDataFrame([(" ".join(a), " ".join(b), " ".join(c))], "a string, b string, c string").select(*[fingerprints.sketch(F.col(x), k=512).alias(x) for x in "abc"])
    near, inside, backwards, n, few, none = row.select(
        fingerprints.resemblance(F.col("a"), F.col("b"), 512),
        fingerprints.containment(F.col("c"), F.col("a"), 512),
        fingerprints.containment(F.col("a"), F.col("c"), 512),
        fingerprints.distinct_shingles(F.col("a"), 512),
        fingerprints.distinct_shingles(fingerprints.sketch(F.lit("a b c d e f g"), k=512), 512),
        fingerprints.resemblance(fingerprints.sketch(F.lit("")), F.col("a"), 512),
    ).first()
    assert abs(near - 0.5) < 0.1 and inside > 0.9 and abs(backwards - 0.5) < 0.1 and abs(n - 2996) < 400 and few == 3 and none == 0


def test_packed_sketches_come_back(spark):
    d = spark.createDataFrame([("a b c d e f g",), ("",), (None,)], "text string").select(fingerprints.sketch(F.col("text")).alias("s"))
    assert all(r[0] == r[1] for r in d.select("s", fingerprints.unpacked(fingerprints.packed(F.col("s")))).collect())
