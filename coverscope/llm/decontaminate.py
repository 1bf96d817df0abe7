"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may stand in a text with up to rate * n edits. It is split into
one piece more than that; whatever the edits are, one piece stays whole (pigeonhole). All
pieces are looked for at once by an Aho-Corasick automaton; around each hit the window
where the item could lie is verified with Myers' bit-parallel edit distance, so that the
result is exact: every (document, item) whose best passage is within the budget.

Texts and items are compared in lower case with white space runs as one space. An item
shorter than whole_chars after that has no edits to spend, as a few letters could be made
of anything: it must stand whole, between word edges. Null and empty items stand nowhere; a
null text holds none. Repeated documents each give rows; items with equal text each give a
row.

The items are a query set: they are read in blocks of a bounded number of characters (about
200 bytes of automaton each), each block sent to all tasks and made into one automaton by
each worker, and every document is searched whole for every block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 400_000


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of nearly equal length with their places."""
    cuts = [i * len(item) // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(item: str) -> dict[str, int]:
    """For each character a number with the bits set where it stands in item."""
    at: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        at[c] |= 1 << i
    return dict(at)


def best_match(m: int, at: dict[str, int], text: str) -> tuple[int, int]:
    """The smallest edit distance of an item of m characters to any passage of text, and where the first such passage ends (Myers 1999)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        same = at.get(c, 0)
        cross = (((same & up) + up) ^ up) | same | down
        rise, fall = down | (full & ~(cross | up)), up & cross
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = (rise << 1) & full, (fall << 1) & full
        vertical = same | down
        up, down = fall | (full & ~(vertical | rise)), rise & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


def groups(n: int) -> list[list[tuple[int, int]]]:
    """For each of n pieces the ranges of pieces with it, from small to large, all pieces left out: halves, halves of halves and so on."""
    around: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def split(a: int, b: int) -> None:
        if b - a < 2:
            return
        middle = (a + b) // 2
        for lo, hi in ((a, middle), (middle, b)):
            split(lo, hi)
            if hi - lo > 1:
                for i in range(lo, hi):
                    around[i].append((lo, hi))

    split(0, n)
    return around


class Matcher:
    """Finds items. Pigeonhole holds for groups of pieces as well: of a split into groups, one with p pieces has at most p - 1 of the edits. So a hit is checked in growing groups, and most chance hits end at the first, short one."""

    def __init__(self, items: list[tuple[int, str]], rate: float, whole_chars: int):
        import ahocorasick

        self.items = items
        self.short = [len(t) < whole_chars for _, t in items]
        self.errors = [0 if short else int(rate * len(t)) for (_, t), short in zip(items, self.short, strict=True)]
        self.masks = [masks(t) for _, t in items]
        places: dict[str, list[tuple[int, int, list]]] = defaultdict(list)
        for k, (_, t) in enumerate(items):
            cut = pieces(t, self.errors[k])
            starts = [a for a, _ in cut] + [len(t)]
            known = {}
            for (at, piece), around in zip(cut, groups(len(cut)), strict=True):
                for lo, hi in around:
                    if (lo, hi) not in known:
                        part = t[starts[lo] : starts[hi]]
                        known[lo, hi] = (starts[lo], len(part), masks(part), hi - lo - 1)
                places[piece].append((k, at, [known[x] for x in around]))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(number of the item, distance, end in the plain text) of the items within their budgets."""
        windows: dict[int, list[tuple[int, int]]] = defaultdict(list)
        whole: dict[int, int] = {}
        for end, (length, where) in self.automaton.iter(text):
            start = end + 1 - length
            for k, at, around in where:
                if self.short[k]:
                    if k not in whole and not text[max(0, start - 1) : start].isalnum() and not text[end + 1 : end + 2].isalnum():
                        whole[k] = end + 1
                    continue
                begin = start - at  # of the item, if there are no edits before the piece
                for offset, n, bits, most in around:
                    lo = begin + offset - most
                    if best_match(n, bits, text[lo if lo > 0 else 0 : begin + offset + n + most])[0] > most:
                        break
                else:
                    e = self.errors[k]
                    windows[k].append((max(0, begin - e), begin + len(self.items[k][1]) + e))
        found = [(k, 0, end) for k, end in whole.items()]
        for k, spans in windows.items():
            spans.sort()
            best = (self.errors[k] + 1, 0)
            lo, hi = spans[0]
            for a, b in [*spans[1:], (1 << 60, 0)]:
                if a <= hi:  # windows that overlap are verified as one
                    hi = max(hi, b)
                    continue
                distance, end = best_match(len(self.items[k][1]), self.masks[k], text[lo:hi])
                best = min(best, (distance, lo + end))
                lo, hi = a, b
            if best[0] <= self.errors[k]:
                found.append((k, *best))
        return found


class Block:
    """Items for all tasks; the automaton is made once by each worker."""

    def __init__(self, items: list[tuple[int, str]], rate: float, whole_chars: int):
        self.items, self.rate, self.whole_chars, self.made = items, rate, whole_chars, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"made": None}

    def matcher(self) -> Matcher:
        if self.made is None:
            self.made = Matcher(self.items, self.rate, self.whole_chars)
        return self.made


def item_blocks(items: DataFrame, item_id: str, text: str, rate: float, whole_chars: int) -> Iterator[Block]:
    """The items in plain form, in blocks of BLOCK_CHARS characters: the driver holds one block at a time."""
    block, n = [], 0
    for r in items.select(F.col(item_id).alias("item"), F.col(text).alias("text")).where("text is not null").toLocalIterator():
        t = plain(r["text"])
        if t:
            block.append((r["item"], t))
            n += len(t)
        if n >= BLOCK_CHARS:
            yield Block(block, rate, whole_chars)
            block, n = [], 0
    if block:
        yield Block(block, rate, whole_chars)


def matches(docs: DataFrame, items: DataFrame, rate: float = 0.1, whole_chars: int = 30, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, distance and end (characters of the plain text) of each item found in each document."""
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}, distance int, end int"
    spark, found = docs.sparkSession, None
    for block in item_blocks(items, item_id, item_text, rate, whole_chars):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = shared.value.matcher()
            for b in batches:
                rows = [
                    (i, matcher.items[k][0], distance, end)
                    for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True)
                    if t
                    for k, distance, end in matcher.find(plain(t))
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (b.schema.field("doc_id").type, None, pa.int32(), pa.int32()), strict=True)], ["doc_id", "item_id", "distance", "end"])

        part = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(search, schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def decontaminate(docs: DataFrame, items: DataFrame, rate: float = 0.1, whole_chars: int = 30, text: str = "text") -> DataFrame:
    """docs without the rows that hold an item; one pass over docs for a block of items, no shuffle."""
    schema = docs.schema
    for block in item_blocks(items, "item_id", "text", rate, whole_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = shared.value.matcher()
            for b in batches:
                yield b.filter(pa.array([not (t and matcher.find(plain(t))) for t in b[text].to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(clean, schema)
    return docs
