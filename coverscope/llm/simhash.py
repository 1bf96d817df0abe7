"""SimHash near-duplicates with vantage-point trees over Hamming distance.

Fingerprints are made of whole texts (see fingerprint()), equal ones become one. A
vantage-point tree over a bounded sample of them cuts the Hamming space into shards: at
each vantage point the fingerprints within the median distance go left, the others right.
Every fingerprint belongs to one shard; by the triangle inequality it can have partners in
just those shards that its ball of `bits` reaches over, and it visits the ones numbered
above its own, so that every pair meets once. Inside a shard a second tree of the shard's
own fingerprints prunes in the same way down to small blocks, which are compared bit for
bit. The pairs are exact, none is dropped; a shard emits a spanning forest of its links
(never more rows than it has fingerprints), and components() joins the forests.

Shards with more than `block` rows are cut into parts, and parts are compared two by two, so
that memory doesn't grow with a crowded region; the comparisons of one region do.

A null text has no words and fingerprint zero, as an empty one. Null ids stay; a group
without any other id has a null component. Equal rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverscope.llm.components import components
from coverscope.llm.shared import written

SEED = 42
WIDE = 32  # words of 64 bits in a wide fingerprint
ANCHORS = 8
SMALL = 64
#: Ids that are sent to all tasks; more are joined by a shuffle.
MAX_BROADCAST = 1_000_000
#: A fingerprint goes out as a signed number.
BIT_ORDER = np.uint64(1) << np.arange(64, dtype=np.uint64)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """The XXH64 hashes of all shingles of `size` lower-cased words, repeats included; of fewer words the whole is one."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, "<u8")
    runs = zip(*(words[i:] for i in range(size)), strict=False) if len(words) >= size else [words]
    return np.array([xxhash.xxh64_intdigest(b" ".join(r), SEED) for r in runs], "<u8")


def fingerprint(text: str | None, size: int = 3) -> int:
    """Bit by bit the majority of the shingles' hashes; without a word 0."""
    h = shingle_hashes(text, size)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(h), 8192):
        ones += np.unpackbits(h[start : start + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(BIT_ORDER[2 * ones > len(h)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), size) for t in b["text"]], np.uint64).view(np.int64)
            yield pa.record_batch({"doc_id": b["doc_id"], "fp": pa.array(fp)})

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, fp bigint")


def distance(points: np.ndarray, other: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ other)


class Tree:
    """Inner nodes: vantage point, radius, left and right child. A child below 0 is shard -1 - child."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.nodes: list[list] = []
        self.n_shards = 0
        self.root = self._grow(sample, max(0, int(np.ceil(np.log2(max(shards, 1))))))

    def _grow(self, points: np.ndarray, depth: int) -> int:
        if depth > 0 and len(points) >= 8:
            d = distance(points, points[0])
            radius = int(np.median(d))
            inside = d <= radius
            if not inside.all():
                at = len(self.nodes)
                self.nodes.append([points[0], radius, 0, 0])
                self.nodes[at][2] = self._grow(points[inside], depth - 1)
                self.nodes[at][3] = self._grow(points[~inside], depth - 1)
                return at
        self.n_shards += 1
        return -self.n_shards

    def reached(self, points: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray]]:
        """Shard by shard the indices of the points whose balls reach into it; reach 0: of those that belong to it."""
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, own = todo.pop()
            if not len(own):
                continue
            if node < 0:
                yield -1 - node, own
                continue
            vantage, radius, left, right = self.nodes[node]
            d = distance(points[own], vantage).astype(np.int64)
            todo += [(left, own[d - reach <= radius]), (right, own[d + reach > radius])]


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Hangs the trees of a[i] and b[i] together, the larger root under the smaller one; parents stay roots."""
    while True:
        ra, rb = parent[a], parent[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        apart = lo != hi
        if not apart.any():
            return
        np.minimum.at(parent, hi[apart], lo[apart])
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def link(points: np.ndarray, queries: np.ndarray, targets: np.ndarray, bits: int, parent: np.ndarray, distance=distance, join=unite) -> None:
    """Joins every query with every target within bits of it. Points are numbers, or rows of them with their own distance."""
    if not len(queries) or not len(targets):
        return
    if len(targets) > 256:
        vantage = points[targets[0]]
        d = distance(points[targets], vantage).astype(np.int64)
        radius = int(np.median(d))
        inside = d <= radius
        if not inside.all():
            q = distance(points[queries], vantage).astype(np.int64)
            link(points, queries[q - bits <= radius], targets[inside], bits, parent, distance, join)
            link(points, queries[q + bits > radius], targets[~inside], bits, parent, distance, join)
            return
    step = max(1, (1 << 20) // (len(targets) * points[0].size))
    for start in range(0, len(queries), step):
        part = queries[start : start + step]
        i, j = np.nonzero(distance(points[part][:, None], points[targets][None, :]) <= bits)
        if len(i):
            join(parent, part[i], targets[j])


def fingerprint_links(distinct: DataFrame, bits: int = 2, sample: int = 16384, shard: int = 32768, block: int = 65536) -> DataFrame:
    """a and b: a forest with the same components as all pairs of the column fp (distinct values) within bits."""
    n = distinct.count()
    picked = distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample).toPandas().fp.to_numpy(np.int64).view(np.uint64)
    # eight sample points a shard at least, so that the medians tell
    tree = Tree(picked, min(-(-n // shard), sample // 8))
    shared = distinct.sparkSession.sparkContext.broadcast(tree)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches:
            fp = b["fp"].to_numpy(zero_copy_only=False)
            home = np.zeros(len(fp), np.int64)
            for s, own in t.reached(fp.view(np.uint64), 0):
                home[own] = s
            for s, own in t.reached(fp.view(np.uint64), bits):
                own = own[home[own] <= s]
                if len(own):
                    yield pa.record_batch({"shard": pa.array(np.full(len(own), s, np.int32)), "fp": pa.array(fp[own]), "member": pa.array(home[own] == s)})

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("fp", ignore_index=True)
        points = rows.fp.to_numpy(np.int64).view(np.uint64)
        parent = np.arange(len(points))
        link(points, np.flatnonzero(rows["query"]), np.flatnonzero(rows.target), bits, parent)
        tied = np.flatnonzero(parent != np.arange(len(points)))
        return pd.DataFrame({"a": rows.fp.to_numpy()[tied], "b": rows.fp.to_numpy()[parent[tied]]})

    routed = distinct.select("fp").mapInArrow(route, "shard int, fp bigint, member boolean")
    sizes = routed.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    parts = F.sequence(F.lit(0), F.col("n") - 1)
    cut = routed.join(F.broadcast(sizes), "shard").withColumn("own", own)  # sizes: a row for each shard
    # part q asks, part t answers: members ask parts from their own on, visitors all; members answer all
    asking = cut.withColumn("t", F.explode(F.filter(parts, lambda t: ~F.col("member") | (t >= F.col("own"))))).select("shard", F.col("own").alias("q"), "t", "fp", F.lit(True).alias("query"), (F.col("member") & (F.col("own") == F.col("t"))).alias("target"))
    answering = cut.where("member").withColumn("q", F.explode(F.filter(parts, lambda q: q != F.col("own")))).select("shard", "q", F.col("own").alias("t"), "fp", F.lit(False).alias("query"), F.lit(True).alias("target"))
    return asking.unionByName(answering).groupBy("shard", "q", "t").applyInPandas(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, bits: int = 2, doc_id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the smallest id among all documents that chains of links reach) of every row."""
    fps = written(fingerprints(docs, doc_id, text, size), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    groups = components(fingerprint_links(distinct, bits))
    rooted = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = rooted.join(rooted.groupBy("component").agg(F.min("first_id").alias("component_id")), "component").select("fp", "component_id")
    return fps.join(named, "fp")


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Another hash of every h, by the finaliser of SplitMix64."""
    x = h + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def sketch(text: str | None, size: int = 5) -> tuple[list[int], bytes, bytes]:
    """The anchors of a text, its fingerprint of 64 * WIDE bits and its shingles as sorted 32-bit hashes; no anchors without a word.

    An anchor is a pair of shingles that are least under two hashes of their own: texts of
    similarity J have the same one with probability J * J.
    """
    h = np.unique(shingle_hashes(text, size))
    if not len(h):
        return [], b"", b""
    least = np.array([mixed(h, k).min() for k in range(1, 2 * ANCHORS + 1)])
    anchors = mixed(least[::2], 1) ^ mixed(least[1::2], 2) ^ mixed(np.arange(ANCHORS, dtype=np.uint64), 3)
    ones = np.zeros(64 * WIDE, np.int64)
    for start in range(0, len(h), 2048):
        part = np.stack([mixed(h[start : start + 2048], 1000 + k) for k in range(WIDE)], axis=1)
        ones += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return anchors.view(np.int64).tolist(), np.packbits(2 * ones > len(h), bitorder="little").tobytes(), np.unique(h.astype("<u4")).tobytes()


def sketches(docs: DataFrame, size: int = 5) -> DataFrame:
    """key (128 bits of the sketch in hex), first_id (the smallest of the documents with it), anchors, wide and shingles of each distinct sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sketch(t.as_py(), size) for t in b["text"]]
            keys = [xxhash.xxh128_hexdigest(w + x) for _, w, x in found]
            yield pa.record_batch({"doc_id": b["doc_id"], "key": pa.array(keys), "anchors": pa.array([a for a, _, _ in found], pa.list_(pa.int64())), "wide": pa.array([w for _, w, _ in found], pa.binary()), "shingles": pa.array([x for _, _, x in found], pa.binary())})

    each = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key string, anchors array<bigint>, wide binary, shingles binary")
    return written(each.groupBy("key").agg(F.min("doc_id").alias("first_id"), *[F.first(c).alias(c) for c in ("anchors", "wide", "shingles")]), "sketches")


def wide_distance(points: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.bitwise_count(points ^ other).sum(axis=-1, dtype=np.int64)


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """The index of two sets, given as sorted arrays."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / max(1, len(x) + len(y) - common)


def unite_alike(parent: np.ndarray, i: np.ndarray, j: np.ndarray, d: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Tells of the pairs that may tie trees of parent together, nearest first, which ones do by their sets; returns these."""
    order, tied = np.argsort(d, kind="stable"), []
    while len(order := order[parent[i[order]] != parent[j[order]]]):
        tried = min(len(order), 64)
        for at in order[:tried]:
            p, q = int(i[at]), int(j[at])
            if parent[p] != parent[q] and jaccard(sets[p], sets[q]) >= similarity:
                unite(parent, i[at : at + 1], j[at : at + 1])
                tied.append((p, q))
        order = order[tried:]
    return tied


def reach_bits(similarity: float) -> tuple[int, int]:
    """The bits in which wide fingerprints can differ, of sets with SMALL members or more, and of smaller ones, whose majorities are coarse."""
    near = 2 * max(0.0, similarity - 0.07) / (1 + max(0.0, similarity - 0.07))
    bits = int(64 * WIDE * np.arccos(near) / np.pi)
    return bits, int(1.35 * bits)


def alike(rows: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """a and b: a forest of the links at each place. rows: key, place, query and target (which sides a sketch is on), wide and shingles."""
    rows = rows.sort_values(["place", "key"], ignore_index=True)
    points = np.frombuffer(b"".join(rows.wide), "<u8").reshape(-1, WIDE)
    sets = [np.frombuffer(x, "<u4") for x in rows.shingles]
    size = np.array([len(x) for x in sets])
    ids, place, query, target = (rows[c].to_numpy() for c in ("key", "place", "query", "target"))
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True])
    links: list[tuple[int, int]] = []
    bits, coarse = reach_bits(similarity)
    for start, end in zip(starts[:-1], starts[1:], strict=True):
        own, parent = points[start:end], np.arange(end - start)

        def join(parent: np.ndarray, i: np.ndarray, j: np.ndarray, start=start, end=end, own=own) -> None:
            links.extend((start + p, start + q) for p, q in unite_alike(parent, i, j, wide_distance(own[i], own[j]), sets[start:end], similarity))

        # a small set has none but small partners: their sizes differ by no more than the similarity
        for members, most in ((size[start:end] >= SMALL, bits), (size[start:end] * similarity < SMALL, coarse)):
            link(own, np.flatnonzero(members & query[start:end]), np.flatnonzero(members & target[start:end]), most, parent, wide_distance, join)
    at = np.array(links, np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": ids[at[:, 0]], "b": ids[at[:, 1]]})


def similar_links(known: DataFrame, similarity: float = 0.8, rows: int = 2048, block: int = 4096, pivots: int = 16) -> DataFrame:
    """a and b: keys, forests that join the same sketches as all pairs whose sets of shingles have a Jaccard index of `similarity` or more.

    Fingerprints of texts so far apart differ in so many bits that one tree of all of them has
    nothing to prune. So sketches meet at their anchors (two texts of similarity 0.8 miss all
    eight with probability 0.0003), where a vantage-point tree of wide fingerprints finds the
    pairs near enough, and these are told by the sets themselves. The bits tell the index to
    about 0.02; the trees' radius takes in pairs down to 0.07 below, and small sets within a
    wider one. Of anchors with the same sketches one is enough.

    An anchor with more than `block` sketches is cut into slices. Each slice is compared with
    itself and with about `pivots` sketches of the whole anchor. That makes most of a family
    of copies one component, whose members need no more comparing; only the others then meet
    all slices. No task has more than about two slices of an anchor at once.
    """
    met = known.select("key", F.explode("anchors").alias("anchor"))
    members = F.sum(F.xxhash64("key").cast("decimal(38,0)"))
    crowds = met.groupBy("anchor").agg(F.count("*").alias("n"), members.alias("members")).where("n > 1")
    crowds = crowds.groupBy("n", "members").agg(F.min("anchor").alias("anchor")).select("anchor", "n", F.ceil(F.col("n") / block).cast("int").alias("n_slices"))
    at = written(met.join(crowds, "anchor").withColumn("slice", F.pmod(F.xxhash64("key"), F.col("n_slices")).cast("int")), "anchors")
    n_buckets = -(-at.count() // rows) or 1

    def compared(placed: DataFrame, what: str) -> DataFrame:
        """placed: key, place, query, target."""
        bucketed = placed.withColumn("bucket", F.pmod("place", F.lit(n_buckets)).cast("int"))
        both = bucketed.join(known.select("key", "wide", "shingles"), "key")
        return written(both.groupBy("bucket").applyInPandas(lambda x: alike(x, similarity), "a string, b string"), what)

    at_slice = lambda s: F.xxhash64("anchor", s)
    own = at.select("key", at_slice(F.col("slice")).alias("place"), F.lit(True).alias("query"), F.lit(True).alias("target"))
    hot = at.where("n_slices > 1")
    pivot = hot.where(F.pmod(F.xxhash64("key", F.lit("pivot")), F.col("n")) < pivots)
    others = lambda s: F.filter(F.sequence(F.lit(0), F.col("n_slices") - 1), lambda x: x != s)
    asked = pivot.select("key", "anchor", F.explode(others(F.col("slice"))).alias("s")).select("key", at_slice(F.col("s")).alias("place"), F.lit(True).alias("query"), F.lit(False).alias("target"))
    links = compared(own.unionByName(asked), "links")
    if hot.isEmpty():
        return links
    grouped = components(links).withColumnRenamed("node", "key")
    named = hot.join(grouped, "key", "left").withColumn("component", F.coalesce("component", "key"))
    counts = named.groupBy("anchor", "component").agg(F.count("*").alias("m"))
    main = counts.groupBy("anchor").agg(F.max_by("component", F.struct("m", "component")).alias("main"))
    named = written(named.join(main, "anchor"), "named")
    rest = named.where("component <> main")
    turns = rest.groupBy("anchor").agg(F.ceil(F.count("*") / block).cast("int").alias("n_turns"))
    place = F.xxhash64("anchor", F.lit("rest"), "turn", "s")
    asking = rest.join(turns, "anchor").withColumn("turn", F.pmod(F.xxhash64("key"), F.col("n_turns")).cast("int"))
    asking = asking.select("key", "anchor", "turn", F.explode(F.sequence(F.lit(0), F.col("n_slices") - 1)).alias("s")).select("key", place.alias("place"), F.lit(True).alias("query"), F.lit(False).alias("target"))
    answering = named.join(turns, "anchor").select("key", "anchor", F.col("slice").alias("s"), F.explode(F.sequence(F.lit(0), F.col("n_turns") - 1)).alias("turn")).select("key", place.alias("place"), F.lit(False).alias("query"), F.lit(True).alias("target"))
    return links.unionByName(compared(asking.unionByName(answering), "links"))


def deduplicated(docs: DataFrame, size: int = 5, similarity: float = 0.8, block: int = 4096) -> DataFrame:
    """docs with one row of each group, that with the smallest id, of equal ids the one first by its columns.

    A group is what links join: equal sketches, and sets of shingles with a Jaccard index of
    `similarity` or more. Rows without an id stay. Texts without a word are copies of each
    other. Of an id with several texts each is compared, and the id stays if it is the
    smallest of any of its groups."""
    named = docs.where("doc_id is not null")
    known = sketches(named, size)
    groups = components(similar_links(known, similarity, block=block)).withColumnRenamed("node", "key")
    firsts = known.select("key", "first_id").join(groups, "key", "left").groupBy(F.coalesce("component", "key")).agg(F.min("first_id").alias("doc_id"))
    ids = named.groupBy("doc_id").agg(F.count("*").alias("n"))
    lost = written(ids.join(firsts.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id"), "lost")
    # texts needn't be shuffled while the ids that go fit a broadcast
    kept = named.join(F.broadcast(lost) if lost.count() <= MAX_BROADCAST else lost, "doc_id", "left_anti")
    if not ids.where("n > 1").isEmpty():
        columns = [c for c in docs.columns if c != "doc_id"]
        kept = kept.groupBy("doc_id").agg(F.min(F.struct(*columns)).alias("_row")).select("doc_id", "_row.*")
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))
