"""Language-model scoring with an Elias-Fano n-gram trie.

Level 1 holds the distinct training tokens by a 64-bit hash, with their exact counts;
level n holds the n-grams seen `cutoff` times or more, each as (index of its first n - 1
words in level n - 1, index of its last word in level 1). A level is cut into shards by a
hash of that pair, so that a very frequent context is spread over all of them. In a shard,
the distinct contexts, the monotone pointers to their successors, and the successors, each
relative to the end of its context's predecessor, are Elias-Fano sequences; probabilities
are quantised to 1/4096 of a decade. Shards are files in the folder that all machines
share; tasks map them into memory and search them: context, its range by two pointers,
successor within that range. Neither the driver nor a task ever holds a level.

Smoothing (a Dirichlet prior at each order): p(w | h) = (c(h w) + prior * p(w | h')) / (C(h)
+ prior), where C(h) sums the counts that the level keeps and h' is h without its first
word; p(w) = (c + 1) / (N + V + 1), with N tokens and V distinct ones in training.

Tokens: words between ASCII white space with A-Z lowered, then one end for each text.
Null texts have just the end, like empty ones. Without training rows every token has
probability 1 / (0 + 0 + 1). Repeated rows count as often as they stand. Columns with the
names of the result's give way to them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverscope.llm.elias_fano import EliasFano, mapped, save
from coverscope.llm.shared import chunks, schema_of, shared_dir, written

CHUNK_BYTES = 6_000_000
STEPS = 4096
#: Of bytes: is it ASCII white space. Of lengths up to 8: the bits of so many bytes.
BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Longer words are hashed one by one.
LONG = 256


def hash_long(x: np.ndarray, seed: np.ndarray | int = 42) -> np.ndarray:
    """XXH64 of numbers of 8 bytes: what xxhash64() gives for a bigint, and for several when each one's hash seeds the next."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    with np.errstate(over="ignore"):
        k = x.view(np.uint64) * p2
        h = (np.asarray(seed, np.uint64) + p5 + np.uint64(8)) ^ (((k << np.uint64(31)) | (k >> np.uint64(33))) * p1)
        h = ((h << np.uint64(27)) | (h >> np.uint64(37))) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


#: The end of a text: as the hash of a word without a byte, which no word is.
END = hash_long(np.zeros(1, np.uint64), 0)[0]


def hash_words(data: bytes, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Codes of words by where they begin and how long they are: eight bytes a step, each step's hash seeds the next, the length the first. data needs seven bytes more at its end."""
    eight, codes = np.ndarray(len(data) - 7, "<u8", data, strides=1), size.astype(np.uint64)
    left, done = np.flatnonzero(size <= LONG), 0
    while len(left):
        value = eight[first[left] + done] & BYTES[np.minimum(size[left] - done, 8)]
        codes[left] = hash_long(value, codes[left])
        done += 8
        left = left[size[left] > done]
    for i in np.flatnonzero(size > LONG):
        codes[i] = xxhash.xxh64_intdigest(data[first[i] : first[i] + size[i]])
    return codes


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token codes of all texts, and where each text starts (one more at the end)."""
    parts = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    data = b"\n".join([*parts, bytes(7)])
    inside = ~BLANK[np.frombuffer(data, np.uint8)]
    inside[-7:] = False
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    first, after = edges[::2], edges[1::2]
    of_text = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), first, "right")
    starts = np.concatenate([[0], np.cumsum(np.bincount(of_text, minlength=len(parts)) + 1)])
    codes = np.full(starts[-1], END, np.uint64)
    codes[np.arange(len(first)) + of_text] = hash_words(data, first, after - first)
    return codes, starts


def pairs(context: np.ndarray, word: np.ndarray, counts: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, and the place of each given one among them (or how often each stands).

    Where a pair fits into one number of 63 bits, one sort does; else both columns are sorted."""
    width = int(word.max(initial=0)) + 1
    if (int(context.max(initial=0)) + 1) * width < 1 << 63:
        key, more = np.unique(context * width + word, return_inverse=not counts, return_counts=counts)
        return *np.divmod(key, width), more
    order = np.lexsort((word, context))
    c, w = context[order], word[order]
    new = np.concatenate([[True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])])
    if counts:
        return c[new], w[new], np.diff(np.append(np.flatnonzero(new), len(order)))
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    return c[new], w[new], at


@dataclass
class Part:
    """A shard: its file, and length and lower bits of each sequence in it."""

    n: int
    address: str
    layout: dict
    sequences: dict[str, tuple[int, int]]

    def sequence(self, name: str) -> EliasFano:
        n, bits = self.sequences[name]
        return EliasFano(n, bits, *(mapped(self.address, self.layout, f"{name}.{x}") for x in ("low", "high", "ones", "zeros")))

    def array(self, name: str) -> np.ndarray:
        return mapped(self.address, self.layout, name)


@dataclass
class Level:
    parts: list[Part]
    bits: int  # there are 2**bits shards
    totals: list[Part] = field(default_factory=list)  # for each shard: what the next level counts after each n-gram

    def __post_init__(self):
        self.offsets = np.cumsum([0, *(p.n for p in self.parts)])

    def _each(self, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        # 16 bits are sorted by radix
        order = np.argsort(shard.astype(np.uint16) if len(self.parts) <= 1 << 16 else shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(len(self.parts) + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            if self.parts[s].n:
                yield int(s), order[cuts[s] : cuts[s + 1]]

    def find_codes(self, codes: np.ndarray) -> np.ndarray:
        """Indices of tokens in level 1, -1 for unknown ones."""
        out = np.full(len(codes), -1, np.int64)
        low = np.uint64(64 - self.bits)
        shard = (codes >> low).astype(np.int64) if self.bits else np.zeros(len(codes), np.int64)
        for s, own in self._each(shard):
            i = self.parts[s].sequence("codes").find(codes[own] & ((np.uint64(1) << low) - np.uint64(1)) if self.bits else codes[own])
            out[own] = np.where(i < 0, -1, i + self.offsets[s])
        return out

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Indices of n-grams, -1 for those that the level doesn't have."""
        out = np.full(len(context), -1, np.int64)
        for s, own in self._each((hash_long(word, hash_long(context)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)):
            part = self.parts[s]
            # callers sort by context: a run of equal ones is looked up once
            own_context = context[own]
            first = np.concatenate([[True], own_context[1:] != own_context[:-1]])
            at = part.sequence("contexts").find(own_context[first].astype(np.uint64))
            known = np.flatnonzero(at >= 0)
            if not len(known):
                continue
            number = np.full(len(at), -1, np.int64)
            number[known] = np.arange(len(known))
            run = number[np.cumsum(first) - 1]
            own, run = own[run >= 0], run[run >= 0]
            pointers, successors = part.sequence("pointers"), part.sequence("successors")
            lo, hi = pointers.access(at[known]).astype(np.int64), pointers.access(at[known] + 1).astype(np.int64)
            base = np.where(lo > 0, successors.access(np.maximum(lo - 1, 0)), np.uint64(0))
            lo, hi, base = lo[run], hi[run], base[run]
            i = successors.find(base + word[own].astype(np.uint64) + np.uint64(1))
            out[own] = np.where((i >= lo) & (i < hi), i + self.offsets[s], -1)
        return out

    def array(self, index: np.ndarray, name: str, totals: bool = False) -> np.ndarray:
        """A value of each n-gram."""
        out = np.zeros(len(index), np.int64)
        for s, own in self._each(np.searchsorted(self.offsets, index, "right") - 1):
            out[own] = (self.totals if totals else self.parts)[s].array(name)[index[own] - self.offsets[s]]
        return out

    def entry(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context and word of n-grams."""
        context, word = np.zeros(len(index), np.int64), np.zeros(len(index), np.int64)
        for s, own in self._each(np.searchsorted(self.offsets, index, "right") - 1):
            i, part = index[own] - self.offsets[s], self.parts[s]
            pointers, successors = part.sequence("pointers"), part.sequence("successors")
            starts = pointers.access(np.arange(pointers.n)).astype(np.int64)
            c = np.searchsorted(starts, i, "right") - 1
            lo = starts[c]
            base = np.where(lo > 0, successors.access(np.maximum(lo - 1, 0)), np.uint64(0))
            context[own] = part.sequence("contexts").access(c).astype(np.int64)
            word[own] = (successors.access(i) - base).astype(np.int64) - 1
        return context, word


@dataclass
class Found:
    """Which n-grams end at tokens: some tokens, what the distinct n-grams have (as a rule their index, -1: not in the model), and the place of each token's among them."""

    tokens: np.ndarray
    index: np.ndarray
    at: np.ndarray

    def of_tokens(self, n: int, none: float = -1) -> np.ndarray:
        out = np.full(n, none, self.index.dtype)
        out[self.tokens] = self.index[self.at]
        return out

    def before(self, starts: np.ndarray, none: float = -1) -> np.ndarray:
        """For every token what the token before it in its text has."""
        out = np.roll(self.of_tokens(int(starts[-1]), none), 1)
        out[starts[:-1]] = none
        return out

    def values(self, value, none: float) -> np.ndarray:
        """value(indices) for the distinct n-grams, none for those not in the model."""
        out, real = np.full(len(self.index), none), self.index >= 0
        out[real] = value(self.index[real])
        return out


@dataclass
class Model:
    levels: list[Level]
    n_tokens: int
    size: int
    prior: float
    cutoff: int

    def word_prob(self, word: np.ndarray) -> np.ndarray:
        count = np.zeros(len(word), np.int64)
        count[word >= 0] = self.levels[0].array(word[word >= 0], "counts")
        return np.log10((count + 1) / (self.n_tokens + self.size + 1))

    def backoff(self, n: int, context: np.ndarray) -> np.ndarray:
        """log10 of the weight that order n leaves to the order below."""
        total = self.levels[n - 2].array(context, "totals", totals=True)
        return np.log10(self.prior / (total + self.prior))

    def suffix(self, n: int, index: np.ndarray) -> np.ndarray:
        """Of n-grams: the (n-1)-gram without the first word, -1 where that isn't kept."""
        context, word = self.levels[n - 1].entry(index)
        if n == 2:
            return word
        shorter, out = self.suffix(n - 1, context), np.full(len(index), -1, np.int64)
        out[shorter >= 0] = self.levels[n - 2].find(shorter[shorter >= 0], word[shorter >= 0])
        return out

    def conditional(self, n: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 p(word | context); context: indices in level n - 1, -1 for none."""
        if n == 1:
            return self.word_prob(word)
        out, real = np.zeros(len(word)), context >= 0
        known = np.full(len(word), -1, np.int64)
        both = real & (word >= 0)
        known[both] = self.levels[n - 1].find(context[both], word[both])
        seen = known >= 0
        out[seen] = -self.levels[n - 1].array(known[seen], "probs") / STEPS
        shorter = np.full(len(word), -1, np.int64)
        if n > 2:
            shorter[real] = self.suffix(n - 1, context[real])
        rest = ~seen
        out[rest] = self.conditional(n - 1, shorter[rest], word[rest])
        out[rest & real] += self.backoff(n, context[rest & real])
        return out

    def read(self, texts: list[str | None], upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[Found]]:
        """Text starts, indices of the distinct tokens, the place of each token among them, and the n-grams that end at tokens for each order."""
        codes, starts = tokens(texts)
        codes, back = np.unique(codes, return_inverse=True)
        ids = self.levels[0].find_codes(codes)
        usual = np.full(len(ids), False)
        usual[ids >= 0] = self.levels[0].array(ids[ids >= 0], "counts") >= self.cutoff
        # rarer words are in no n-gram
        orders = [Found(np.arange(len(back)), np.where(usual, ids, -1), back)]
        kept = orders[0].of_tokens(len(back))
        for n in range(2, upto + 1):
            context = orders[-1].before(starts)
            both = np.flatnonzero((context >= 0) & (kept >= 0))
            c, w, at = pairs(context[both], kept[both])
            orders.append(Found(both, self.levels[n - 1].find(c, w), at))
        return starts, ids, back, orders

    def score(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        starts, ids, back, orders = self.read(texts, len(self.levels))
        base = self.word_prob(ids)[back]
        best = base
        for n, (below, own) in enumerate(zip(orders, orders[1:], strict=False), 2):
            # what is known of a distinct n-gram is looked up once
            weight = Found(below.tokens, below.values(lambda i: self.backoff(n, i), 0.0), below.at).before(starts, 0.0)
            best = best + weight
            log_p = own.values(lambda i: -self.levels[n - 1].array(i, "probs") / STEPS, 0.0)
            seen = (own.index >= 0)[own.at]
            best[own.tokens[seen]] = log_p[own.at[seen]]
        add = lambda x: np.add.reduceat(x, starts[:-1])
        return {"n_tokens": np.diff(starts), "n_known": add((ids >= 0).astype(np.int64)[back]), "base_score": add(base), "score": add(best)}


def _sequence(arrays: dict, name: str, values: np.ndarray) -> tuple[int, int]:
    bits, own = EliasFano.arrays(values)
    arrays |= {f"{name}.{k}": a for k, a in own.items()}
    return len(values), bits


def _small(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint32) if not len(values) or values.max() < 1 << 32 else values.astype(np.uint64)


def _shards(rows: DataFrame, build, n_shards: int, folder: str) -> list[Part]:
    """Files of rows (shard and other columns), made by build(shard, columns) -> (n, arrays, sequences)."""
    columns = [c for c in rows.columns if c != "shard"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(shard: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            n, arrays, sequences = build(shard, {c: np.concatenate([p[c].to_numpy(zero_copy_only=False) for p in parts]) for c in columns})
            address, layout = save(folder, arrays)
            return pa.record_batch({"shard": pa.array([shard], pa.int32()), "part": pa.array([json.dumps([n, address, layout, sequences])])})

        now, parts = None, []
        for b in batches:  # in the order of the shards
            shards = b["shard"].to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1), len(shards)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    if now is not None and shards[lo] != now:
                        yield made(now, parts)
                        parts = []
                    now = int(shards[lo])
                    parts.append(b.slice(lo, hi - lo))
        if now is not None:
            yield made(now, parts)

    found = {r.shard: Part(*json.loads(r.part)) for r in rows.repartition(n_shards, "shard").sortWithinPartitions("shard").mapInArrow(run, "shard int, part string").collect()}
    return [found.get(s) or Part(0, "", {}, {}) for s in range(n_shards)]


def _bits(n: int, per_shard: int) -> int:
    return max(0, int(np.ceil(np.log2(max(n, 1) / per_shard))))


Counts = tuple[np.ndarray, ...]  # columns of a key, then how often it stands


def _added(*counts: np.ndarray) -> Counts:
    """Distinct keys with the sums of their counts."""
    *key, n = counts
    *key, at = np.unique(*key, return_inverse=True) if len(key) == 1 else pairs(*key)
    return *key, np.bincount(at, n, len(key[0])).astype(np.int64)


def _merged(parts: Iterator[Counts], most: int = 1 << 21) -> Iterator[Counts]:
    """Counts of fewer, larger parts: successive ones are added up until they have more than `most` keys."""
    held: list[Counts] = []
    for part in parts:
        held.append(part)
        if sum(len(p[0]) for p in held) > most:
            held = [_added(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            if len(held[0][0]) > most // 2:
                yield held.pop()
    yield from held


def _counted(docs: DataFrame, run, key: list[str], cutoff: int) -> DataFrame:
    """The keys with their sums n, as a written table. run gives the keys and counts of batches."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for counts in _merged(run(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in counts], [*key, "n"])

    return written(docs.mapInArrow(rows, ", ".join(f"{c} bigint" for c in [*key, "n"])).groupBy(*key).agg(F.sum("n").alias("n")).where(F.col("n") >= cutoff), "ngrams")


def train(docs: DataFrame, text: str = "text", order: int = 3, cutoff: int = 2, prior: float = 50.0, per_shard: int = 1 << 20) -> Model:
    """The model of the texts of docs."""
    docs, folder = docs.select(F.col(text).alias("text")), f"{shared_dir(docs.sparkSession)}/trie"

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[Counts]:
        for b in batches:
            for c in chunks(b, "text", CHUNK_BYTES):
                yield np.unique(tokens(c["text"].to_pylist())[0].view(np.int64), return_counts=True)

    words = _counted(docs, count_words, ["code"], 1)
    size, n_tokens = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = _bits(size, per_shard)

    def build_words(shard: int, own: dict) -> tuple[int, dict, dict]:
        codes = own["code"].view(np.uint64)
        order_ = np.argsort(codes)
        arrays = {"counts": _small(own["n"][order_])}
        low = codes[order_] & np.uint64((1 << (64 - bits)) - 1)
        return len(codes), arrays, {"codes": _sequence(arrays, "codes", low)}

    shard = F.shiftrightunsigned("code", 64 - bits) if bits else F.lit(0)
    model = Model([Level(_shards(words.withColumn("shard", shard.cast("int")), build_words, 1 << bits, folder), bits)], n_tokens, size, prior, cutoff)
    for n in range(2, order + 1):
        _grow(model, docs, n, per_shard, folder)
    return model


def _grow(model: Model, docs: DataFrame, n: int, per_shard: int, folder: str) -> None:
    """Adds level n."""
    known = replace(model, levels=list(model.levels))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[Counts]:
        for b in batches:
            for c in chunks(b, "text", CHUNK_BYTES):
                starts, _, back, orders = known.read(c["text"].to_pylist(), n - 1)
                context, kept = orders[-1].before(starts), orders[0].of_tokens(len(back))
                # an n-gram is no more frequent than its last n - 1 words
                both = (context >= 0) & (orders[-1].of_tokens(len(back)) >= 0)
                yield pairs(context[both], kept[both], counts=True)

    grams = _counted(docs, count, ["context", "word"], model.cutoff)
    below = known.levels[-1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.searchsorted(below.offsets, b["context"].to_numpy(zero_copy_only=False), "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), b["context"], b["total"]], ["shard", "context", "total"])

    def build_totals(shard: int, own: dict) -> tuple[int, dict, dict]:
        totals = np.zeros(below.parts[shard].n, np.int64)
        totals[own["context"] - below.offsets[shard]] = own["total"]
        return len(totals), {"totals": _small(totals)}, {}

    sums = grams.groupBy("context").agg(F.sum("n").alias("total"))
    totals = _shards(sums.mapInArrow(place, "shard int, context bigint, total bigint"), build_totals, len(below.parts), folder)
    empty = {i: save(folder, {"totals": np.zeros(p.n, np.uint32)}) for i, p in enumerate(below.parts) if p.n and not totals[i].n}
    below.totals = [Part(p.n, *empty[i], {}) if i in empty else totals[i] for i, p in enumerate(below.parts)]
    bits = _bits(grams.count(), per_shard)

    def build(shard: int, own: dict) -> tuple[int, dict, dict]:
        order_ = np.lexsort((own["word"], own["context"]))
        context, word, times = (own[c][order_] for c in ("context", "word", "n"))
        contexts, starts = np.unique(context, return_index=True)
        pointers = np.append(starts, len(word)).astype(np.uint64)
        # each successor counts from the last one of the context before
        last = word[np.append(starts[1:], len(word)) - 1].astype(np.uint64) + np.uint64(1)
        base = np.concatenate([np.zeros(1, np.uint64), np.cumsum(last, dtype=np.uint64)[:-1]])
        successors = np.repeat(base, np.diff(pointers).astype(np.int64)) + word.astype(np.uint64) + np.uint64(1)
        lower = known.conditional(n - 1, known.suffix(n - 1, context) if n > 2 else np.full(len(word), -1, np.int64), word)
        total = below.array(context, "totals", totals=True)
        p = (times + known.prior * 10**lower) / (total + known.prior)
        arrays = {"probs": np.minimum(np.rint(-np.log10(p) * STEPS), 65535).astype(np.uint16)}
        return len(word), arrays, {"contexts": _sequence(arrays, "contexts", contexts.astype(np.uint64)), "pointers": _sequence(arrays, "pointers", pointers), "successors": _sequence(arrays, "successors", successors)}

    rows = grams.withColumn("shard", F.pmod(F.xxhash64("context", "word"), F.lit(1 << bits)).cast("int"))
    model.levels.append(Level(_shards(rows, build, 1 << bits, folder), bits))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with n_tokens, n_known, base_score and lm_score (log10)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # file names and sizes of the shards
    names = {"n_tokens": "bigint", "n_known": "bigint", "base_score": "double", "lm_score": "double"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for own in chunks(b, text, CHUNK_BYTES):
                got = m.score(own[text].to_pylist())
                got["lm_score"] = got.pop("score")
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(got[c].astype(np.int64 if kind == "bigint" else np.float64)) for c, kind in names.items())], [*own.schema.names, *names])

    kept = docs.drop(*names)
    return kept.mapInArrow(run, ", ".join([schema_of(kept), *(f"{c} {kind}" for c, kind in names.items())]))
