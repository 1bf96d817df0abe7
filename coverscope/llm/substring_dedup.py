"""Fuzzy repeated passages across documents by collinear chaining.

Seeds are k-mers of k lower-cased words; of each `window` successive ones the one with the
smallest hash is taken, so every run of k + window - 1 equal words has a common seed. Of
all documents with a seed the first (smallest id) is its source; every other occurrence is
matched to the source's first one. So matches grow with the seeds, whatever the size of a
group of copies. The matches of a (document, source) pair are merged along diagonals and
chained: a chain's score is the words it covers less a cost for the words it skips, found
in order of the document with a Fenwick tree over places in the source. Chains are then
extended along their outer diagonals and aligned word by word between their parts.

A first document can hold a fragment of a passage and so take the seeds that a later one,
with the whole of it, needs. So every run of min_words words, in stretches where all seeds
are repeated, that no long span holds is matched once more, by the run itself: to the
first document with that run, which holds all of it. Then every run of min_words words
that an earlier document has lies in a span with a source of its own. Runs are sent packed,
those in a row with the same least k-mer as one piece of text, and only pieces with a k-mer
that an open run and another document have are taken apart.

A document's aligned spans, over all its sources, that touch or overlap are one passage; the
result has the passages of at least min_words words, each with its longest span's source
and all its spans with their own sources.

Words are those between white space, in lower case; alignment compares 16-bit hashes of
them. Documents with null text or fewer than k words have no passages; null ids are
left out, as a passage could not be told by them. Of rows with the same id, all are
read as one document's seeds, and passages are found against other ids alone. The source
of a passage has no row of its own for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coverscope.llm.shared import chunks, written

CHUNK_BYTES = 4_000_000
MARGIN = 64  # words on either side that an extension can reach
EACH = 16  # rows that joining a pair of seeds may make for each row with it
BLOCKS, BLOCK_BYTES = (1024, 4096), 8_000_000  # documents and sources with a more frequent one that meet at once, and bytes of either
AT_ONCE = 200_000  # rows of shared pairs that a meeting looks at in one step
AROUND = (0, 1, 2, 4, 8, 16)  # equal words beside a span, by which sources of the same span are told apart
GAP_COST = 0.05  # of a word skipped in a document or its source


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").lower().encode("utf-8", "replace").split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-mers; those of longer ones come from two of about half their length."""

    def sums(k: int) -> np.ndarray:
        if k == 1:
            return h
        half = k // 2
        whole = sums(half)
        two = whole[:-half] * np.uint64(pow(0x9E3779B97F4A7C15, half, 1 << 64)) + whole[half:]
        return two if k % 2 == 0 else two[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[k - 1 :]

    with np.errstate(over="ignore"):
        kmers = sums(k).copy()
        kmers ^= kmers >> np.uint64(31)
        kmers *= np.uint64(0xBF58476D1CE4E5B9)
        kmers ^= kmers >> np.uint64(29)
    return kmers


def sliding(of: np.ufunc, values: np.ndarray, window: int) -> np.ndarray:
    """np.minimum or np.maximum of every `window` successive values."""
    width = 1  # doubled until it is wide enough
    while width < window:
        step = min(width, window - width)
        values, width = of(values[:-step], values[step:]), width + step
    return values


def seeds(h: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the k-mers that are the least of some window."""
    n = len(h) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kmers = rolled(h, k)
    if n <= window:
        at = np.array([int(kmers.argmin())])
    else:
        edge = np.zeros(window - 1, np.uint64)
        most = sliding(np.maximum, np.concatenate([edge, sliding(np.minimum, kmers, window), edge]), window)
        at = np.flatnonzero(most == kmers)  # the least of a window of theirs
        if ((kmers[at[1:]] == kmers[at[:-1]]) & (np.diff(at) < window)).any():  # equal ones in a window: the first counts
            least = np.lib.stride_tricks.sliding_window_view(kmers, window).argmin(axis=1) + np.arange(n - window + 1)
            at = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return kmers[at], at


def read_words(docs: DataFrame, k: int, window: int) -> DataFrame:
    """doc_id, seeds, pos and codes (two bytes a word) of each document, from one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b, "text", CHUNK_BYTES):
                hashes = [word_hashes(t.as_py()) for t in c["text"]]
                got = [seeds(h, k, window) for h in hashes]
                ends = pa.array(np.cumsum([0, *(len(p) for _, p in got)]).astype(np.int32))
                s, p = np.concatenate([s for s, _ in got]).view(np.int64), np.concatenate([p for _, p in got]).astype(np.int32)
                codes = pa.array([(h >> np.uint64(48)).astype("<u2").tobytes() for h in hashes], pa.binary())
                yield pa.record_batch({"doc_id": c["doc_id"], "seeds": pa.ListArray.from_arrays(ends, pa.array(s)), "pos": pa.ListArray.from_arrays(ends, pa.array(p)), "codes": codes})

    return written(docs.mapInArrow(run, "doc_id bigint, seeds array<bigint>, pos array<int>, codes binary"), "words")


def seed_table(read: DataFrame) -> DataFrame:
    """seed, doc_id and pos."""
    return read.select("doc_id", F.inline(F.arrays_zip(F.col("seeds").alias("seed"), F.col("pos")))).select("seed", "doc_id", "pos")


def matches(table: DataFrame) -> DataFrame:
    """seed, doc_id, pos, source_id and source_pos of every seed that two documents have; source_id is the first of them, also for itself."""
    first = (
        table.groupBy("seed")
        .agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.max("doc_id").alias("last"))
        .where(F.col("last") > F.col("first.doc_id"))
        .select("seed", F.col("first.doc_id").alias("source_id"), F.col("first.pos").alias("source_pos"))
    )
    first = written(first, "seeds")  # both sides of the join are shuffles then, so that Spark can split a frequent seed
    return table.join(first, "seed").select("seed", "doc_id", "pos", "source_id", "source_pos")


def stretches(pos: np.ndarray, k: int, window: int, min_words: int) -> list[tuple[int, int]]:
    """Where runs of min_words words can lie all of whose seeds are among those at pos (sorted)."""
    cuts = np.flatnonzero(np.diff(pos) > window) + 1
    ends = [(max(0, int(x[0]) - window + 1), int(x[-1]) + k + window - 1) for x in np.split(pos, cuts)]
    return [(lo, hi) for lo, hi in ends if hi - lo >= min_words]


def repeated(seen: DataFrame, spans: DataFrame, codes: DataFrame, k: int, window: int, min_words: int) -> DataFrame:
    """least, doc_id, start, codes, open and asks of the runs of min_words words in stretches of repeated seeds.

    Runs in a row with the same least k-mer are one row, with the codes of them all. open tells for each of them whether
    an earlier document can have it, as all its seeds have earlier ones, and no span holds it; asks, whether any is open."""
    columns = {"least": pa.int64(), "doc_id": pa.int64(), "start": pa.int32(), "codes": pa.binary(), "open": pa.binary(), "asks": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in columns]
            for doc, pos, later, held, text in zip(*(b[x].to_pylist() for x in ("doc_id", "pos", "later", "held", "codes")), strict=True):
                mine = stretches(np.sort(np.array(later)), k, window, min_words) if later else []
                for lo, hi in stretches(np.sort(np.array(pos)), k, window, min_words):
                    own = text[2 * lo : 2 * hi]
                    n = len(own) // 2 - min_words + 1
                    if n < 1:
                        continue
                    free = np.zeros(n, np.uint8)
                    for x, y in mine:
                        free[max(0, x - lo) : max(0, y - min_words + 1 - lo)] = 1
                    for x in held or ():
                        free[max(0, x["start"] - lo) : max(0, x["end"] - min_words + 1 - lo)] = 0
                    least = sliding(np.minimum, rolled(np.frombuffer(own, "<u2").astype(np.uint64), k), min_words - k + 1)
                    cuts = [0, *(np.flatnonzero(least[1:] != least[:-1]) + 1).tolist()]
                    asks = np.maximum.reduceat(free, cuts).astype(bool).tolist()
                    free, least = free.tobytes(), least[cuts].view(np.int64).tolist()
                    for x, y, key, any_ in zip(cuts, [*cuts[1:], n], least, asks, strict=True):
                        for to, value in zip(out, (key, doc, lo + x, own[2 * x : 2 * (y + min_words - 1)], free[x:y], any_), strict=True):
                            to.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, columns.values(), strict=True)], list(columns))

    later = F.collect_set(F.when(F.col("doc_id") != F.col("source_id"), F.col("pos"))).alias("later")
    places = seen.groupBy("doc_id").agg(F.collect_set("pos").alias("pos"), later)
    held = spans.where(F.col("end") - F.col("start") >= min_words).groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("held"))
    rows = places.join(held, "doc_id", "left").join(codes.withColumnRenamed("id", "doc_id"), "doc_id")
    return rows.mapInArrow(run, "least bigint, doc_id bigint, start int, codes binary, open binary, asks boolean")


def turns(row: np.ndarray, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of some places, in order, the how-manieth of its row with that key it is, how many there are and how far apart; 0, 1, 0 where they are not evenly spaced."""
    turn, size, step = np.zeros(len(key), np.int32), np.ones(len(key), np.int32), np.zeros(len(key), np.int32)
    order = np.lexsort((at, key, row))
    new = np.flatnonzero(np.concatenate([[True], (np.diff(row[order]) != 0) | (key[order][1:] != key[order][:-1])]))
    if len(new) < len(key):
        group = np.repeat(np.arange(len(new)), count := np.diff(np.append(new, len(key))))
        gap = np.diff(at[order], prepend=0)
        gap[new] = gap[np.minimum(new + 1, len(key) - 1)]  # a first one counts as its successor
        even = ((np.minimum.reduceat(gap, new) == np.maximum.reduceat(gap, new)) & (count > 1))[group]
        turn[order] = np.where(even, np.arange(len(key)) - new[group], 0)
        size[order] = np.where(even, count[group], 1)
        step[order] = np.where(even, gap, 0)
    return turn, size, step


def run_matches(table: DataFrame, min_words: int) -> DataFrame:
    """As matches(), of the open runs (see repeated()) that an earlier document has. A run is known by a hash of its word codes.

    In periodic text a run comes again and again. Its turns in a document meet the source's own turns one by one, so that they
    lie on one diagonal as long as the source goes on, and not on one for each turn."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b, "codes", CHUNK_BYTES // 8):
                codes, free = (np.frombuffer(b"".join(c[x].to_pylist()), kind) for x, kind in (("codes", "<u2"), ("open", np.uint8)))
                size = np.array([len(x) for x in c["open"].to_pylist()])
                row, ends = np.repeat(np.arange(len(size)), size), np.cumsum(size)
                within = np.arange(len(row)) - np.repeat(ends - size, size)
                key = rolled(codes.astype(np.uint64), min_words)[np.arange(len(row)) + row * (min_words - 1)]
                at = within + c["start"].to_numpy()[row]
                turn, n, step = turns(row, key, at)
                yield pa.record_batch({"seed": pa.array(key.view(np.int64)), "doc_id": pa.array(c["doc_id"].to_numpy()[row]), "pos": pa.array(at.astype(np.int32)), "turn": pa.array(turn), "size": pa.array(n), "step": pa.array(step), "open": pa.array(free.astype(bool))})

    asking = table.groupBy("least").agg(F.min("doc_id").alias("first"), F.max(F.when(F.col("asks"), F.col("doc_id"))).alias("last")).where("last > first")
    each = table.join(written(asking.select("least"), "asking"), "least", "left_semi").select("doc_id", "start", "codes", "open").mapInArrow(runs, "seed bigint, doc_id bigint, pos int, turn int, size int, step int, open boolean")
    first = (
        each.groupBy("seed")
        .agg(F.min(F.struct("doc_id", "pos", "size", "step")).alias("first"), F.max(F.when(F.col("open"), F.col("doc_id"))).alias("last"))
        .where(F.col("last") > F.col("first.doc_id"))
        .select("seed", F.col("first.doc_id").alias("source_id"), F.col("first.pos").alias("_pos"), F.col("first.size").alias("_size"), F.col("first.step").alias("_step"))
    )
    source_pos = (F.col("_pos") + F.col("turn") % F.col("_size") * F.col("_step")).alias("source_pos")
    return each.where("open").select("seed", "doc_id", "pos", "turn").join(written(first, "runs"), "seed").where(F.col("doc_id") != F.col("source_id")).select("doc_id", "pos", "source_id", source_pos)


def pair_keys(seed: np.ndarray, pos: np.ndarray, far: int, run: int, held: np.ndarray | None = None, reaching: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key and both places of the ordered pairs of seeds (sorted by place) at most far words apart.

    Left out are pairs that lie in one of the held spans (start, last place of a seed), those of stretches (without a
    gap of more than far words) that reach over less than reaching words, and of equal pairs less than run words apart all but the first."""
    use = np.ones(len(pos), bool)
    if reaching:
        starts = np.flatnonzero(np.concatenate([[True], np.diff(pos) > far]))
        wide = np.append(pos[starts[1:] - 1], pos[-1]) - pos[starts] >= reaching
        use = np.repeat(wide, np.diff(np.append(starts, len(pos))))
    if held is not None and len(held):
        held = held[np.argsort(held[:, 0], kind="stable")]
        most = np.maximum.accumulate(held[:, 1])  # the farthest end of the spans that start up to there
    one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for apart in range(1, len(pos)):
        gap = pos[apart:] - pos[:-apart]
        if (gap > far).all():
            break
        near = np.flatnonzero((gap <= far) & (gap > 0) & use[apart:])
        if held is not None and len(held) and len(near):
            at = np.searchsorted(held[:, 0], pos[near], "right")
            near = near[(at == 0) | (pos[near + apart] > most[at - 1])]
        one.append(near)
        two.append(near + apart)
    i, j = np.concatenate(one), np.concatenate(two)
    with np.errstate(over="ignore"):
        key = (seed[i].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + seed[j].view(np.uint64)).view(np.int64)
    order = np.lexsort((pos[j], pos[i], key))
    key, p, q = key[order], pos[i][order], pos[j][order]
    new = np.concatenate([[True], (np.diff(key) != 0) | (np.diff(p) >= run)]) if len(key) else np.zeros(0, bool)
    return key[new], p[new], q[new]


def keyed(rows: DataFrame, k: int, window: int, max_gap: int, reaching: int = 0) -> DataFrame:
    """key, doc_id and the places p and q (see pair_keys()). rows: doc_id, at (structs of pos and seed) and, where pairs in one span don't count, held (structs of start and end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, out = [], []
            at, spans = b["at"], b["held"] if "held" in b.schema.names else None
            ends, flat = at.offsets.to_numpy(), at.values
            if spans is not None:
                cuts = spans.offsets.to_numpy()
                all_ = np.stack([spans.values.field("start").to_numpy(zero_copy_only=False), spans.values.field("end").to_numpy(zero_copy_only=False) - k], axis=1)
            pos, seed = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("pos", "seed"))
            for i, doc in enumerate(b["doc_id"].to_pylist()):
                lo, hi = ends[i], ends[i + 1]
                order = np.lexsort((seed[lo:hi], pos[lo:hi]))
                own = None if spans is None else all_[cuts[i] : cuts[i + 1]]
                out.append(pair_keys(seed[lo:hi][order], pos[lo:hi][order], max_gap + k, window, own, reaching))
                docs.append(np.full(len(out[-1][0]), doc, np.int64))
            if docs:
                key, p, q = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.record_batch({"key": pa.array(key), "doc_id": pa.array(np.concatenate(docs)), "p": pa.array(p.astype(np.int32)), "q": pa.array(q.astype(np.int32))})

    return rows.mapInArrow(run, "key bigint, doc_id bigint, p int, q int")


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1 ... of sizes[0] numbers, then those of the next."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def extended(same: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """reach() of each row of same up to its n, how many words are unequal up to there, with how many equal ones in a row it starts, and whether it ends before the row does."""
    valid = np.arange(same.shape[1]) < n[:, None]
    score = np.cumsum(np.where(same, 1, -3), axis=1, dtype=np.int16)
    over = (np.maximum.accumulate(np.maximum(score, 0), axis=1) - score > 8) | ~valid
    over = np.logical_or.accumulate(over, axis=1)
    score[over] = -999
    best = score.argmax(axis=1)
    most = score[np.arange(len(n)), best]
    far = np.where(most > 0, best + 1, 0)
    equal = np.where((gap := ~(same & valid)).any(axis=1), gap.argmax(axis=1), same.shape[1])
    return far, np.where(far > 0, (far - most) // 4, 0), equal, over[:, -1]


class Side:
    """Documents of a meeting: ids, word codes one after the other, and their pairs (row of the document, key, p, q and hot)."""

    def __init__(self, table: pa.Table) -> None:
        self.ids, self.lo = table["id"].to_numpy(), table["lo"].to_numpy().astype(np.int64)
        texts = table["codes"].to_pylist()
        size = np.array([len(x) // 2 for x in texts], np.int64)
        edge = bytes(2 * MARGIN)
        self.codes, self.end = np.frombuffer(edge + b"".join(texts) + edge, "<u2"), self.lo + size
        self.shift = np.cumsum(size) - size - self.lo + MARGIN  # the word at place x of document i has the code at x + shift[i]
        pairs = table["pairs"].combine_chunks()
        self.row = np.repeat(np.arange(len(self.ids)), np.diff(pairs.offsets.to_numpy()))
        self.key, self.p, self.q, self.hot = (pairs.flatten().field(x).to_numpy(zero_copy_only=False) for x in ("key", "p", "q", "hot"))

    def words(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.codes[at + self.shift[rows]]


def outcomes(left: Side, right: Side, i: np.ndarray, j: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Start, end, edits and steps of AROUND on either side that align() has for chains of one part each (see diagonals()), one for each of the documents i and sources j."""
    out = []
    for at in np.array_split(np.arange(len(i)), max(1, len(i) // 8192)):
        x, y, (a, b, size) = i[at], j[at], parts[at].T
        back = np.minimum(np.minimum(a - left.lo[x], b - right.lo[y]), MARGIN)
        on = np.minimum(np.minimum(left.end[x] - a - size, right.end[y] - b - size), MARGIN)
        sides = []
        for n, way, p, q in ((back, -1, a - 1, b - 1), (on, 1, a + size, b + size)):
            told, open_ = np.zeros((3, len(at)), np.int64), np.arange(len(at))
            for width in (8, MARGIN):  # most end after few words
                steps = way * np.arange(width)
                *got, ended = extended(left.words(x[open_, None], p[open_, None] + steps) == right.words(y[open_, None], q[open_, None] + steps), n[open_])
                told[:, open_] = got
                open_ = open_[~ended]
            sides.append(told)
        row = np.repeat(np.arange(len(at)), size)
        unequal = left.words(x[row], ranges(a, size)) != right.words(y[row], ranges(b, size))
        wrong = np.bincount(row, unequal, len(at)).astype(np.int64) + sides[0][1] + sides[1][1]
        around = [np.searchsorted(AROUND, equal, "right") for _, _, equal in sides]
        out.append(np.stack([a - sides[0][0], a + size + sides[1][0], wrong, *around], axis=1))
    return np.concatenate(out)


def met(key: int, left: Side, right: Side, k: int, max_gap: int) -> tuple[np.ndarray, ...]:
    """Rows (of left, of right) of pairs that documents and earlier sources share, for those that meet at the key and whose spans no smaller source of them gives."""
    common = np.intersect1d(left.key, right.key)
    mine, theirs = np.flatnonzero(np.isin(left.key, common)), np.flatnonzero(np.isin(right.key, common))
    theirs = theirs[np.argsort(right.key[theirs], kind="stable")]
    rows = lambda theirs: [np.searchsorted(right.key[theirs], left.key[mine], side) for side in ("left", "right")]
    whole = np.bincount(left.row[mine], np.subtract(*rows(theirs)[::-1]), len(left.ids))
    n = max(1, -(-int(whole.max(initial=0)) // AT_ONCE))  # parts of the sources: so many rows of a document come to one of them
    slices = []
    for part in range(n):
        own = theirs[right.row[theirs] % n == part]
        first, last = rows(own)
        cuts = np.flatnonzero(np.diff(np.cumsum(np.bincount(left.row[mine], last - first, len(left.ids))) // AT_ONCE)) + 1
        slices += [(own, first, last, docs) for docs in np.split(np.arange(len(left.ids)), cuts) if len(docs)]
    found = [(np.zeros(0, np.int64),) * 2]
    for theirs, first, last, docs in slices:
        own = np.flatnonzero((left.row[mine] >= docs[0]) & (left.row[mine] <= docs[-1]))
        x, y = np.repeat(mine[own], last[own] - first[own]), theirs[ranges(first[own], last[own] - first[own])]
        earlier = right.ids[right.row[y]] < left.ids[left.row[x]]
        x, y = x[earlier], y[earlier]
        g = left.row[x] * len(right.ids) + right.row[y] - docs[0] * len(right.ids)
        elsewhere, mixed = np.zeros((2, len(docs) * len(right.ids)), bool)
        elsewhere[g[left.hot[x] & (left.key[x] < key)]] = True  # these meet at their least frequent pair
        mixed[g[~left.hot[x]]] = True  # their other pairs are joined one by one, so these stay with them
        here = ~elsewhere[g]
        x, y, g = x[here], y[here], g[here]
        keep = mixed.copy()
        one = ~mixed[g]
        plain = one & (np.bincount(g, minlength=len(keep))[g] == 1) & (left.q[x] - left.p[x] == right.q[y] - right.p[y])  # a pair alone, on one diagonal
        several = one & ~plain
        of, a, b = np.tile(g[several], 2), np.concatenate([left.p[x[several]], left.q[x[several]]]), np.concatenate([right.p[y[several]], right.q[y[several]]])
        order = np.lexsort((a, a - b, of))
        of, a, b = of[order], a[order], b[order]
        differ = lambda z, most: np.diff(z, prepend=z[:1] - most - 1) > most
        new = np.flatnonzero(differ(of, 0) | (np.diff(a - b, prepend=0) != 0) | differ(a, max_gap + k))
        ends = np.append(new[1:], len(a))[: len(new)] - 1
        parts = np.stack([np.append(a[new], left.p[x[plain]]), np.append(b[new], right.p[y[plain]]), np.append(a[ends] + k - a[new], left.q[x[plain]] + k - left.p[x[plain]])], axis=1).astype(np.int64)
        of = np.append(of[new], g[plain])
        if len(of):
            linked = np.zeros(len(keep), bool)  # those with parts that a chain can hold together
            for apart in range(1, len(of)):
                u = np.flatnonzero(of[apart:] == of[:-apart])
                if not len(u):
                    break
                gaps = [[parts[w, c] - parts[v, c] - parts[v, 2] for c in (0, 1)] for v, w in ((u, u + apart), (u + apart, u))]
                near = np.logical_or(*[(ga >= 0) & (ga <= max_gap) & (gb >= 0) & (gb <= max_gap) for ga, gb in gaps])
                linked[of[u[near]]] = True
            alone = np.flatnonzero(~linked[of] & (parts[:, 2] > k))
            doc, source = of // len(right.ids) + docs[0], of % len(right.ids)
            if len(alone):
                told = np.concatenate([doc[alone, None], outcomes(left, right, doc[alone], source[alone], parts[alone])], axis=1)
                by = np.lexsort((right.ids[source[alone]], *told.T))
                keep[of[alone[by[np.concatenate([[True], (np.diff(told[by], axis=0) != 0).any(axis=1)])]]]] = True
            seen: dict = {}
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(of) != 0]))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(of)), strict=True):
                if linked[of[lo]]:
                    d, c = int(doc[lo]), int(source[lo])
                    text, other = (z.codes[z.lo[r] + z.shift[r] : z.end[r] + z.shift[r]] for z, r in ((left, d), (right, c)))
                    spans = (align(piece, text, int(left.lo[d]), other, int(right.lo[c])) for piece in pieces(parts[lo:hi], k, max_gap, 2))
                    for start, end, _, _, wrong in spans:
                        was = seen.get((d, start, end, wrong))
                        if was is None or right.ids[c] < right.ids[was[1]]:
                            seen[d, start, end, wrong] = (of[lo], c)
            keep[[g_ for g_, _ in seen.values()]] = True
        use = keep[g] & left.hot[x]
        found.append((x[use], y[use]))
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))


def pair_matches(open_: DataFrame, sources: DataFrame, codes: DataFrame, k: int, each: int, max_gap: int = 20) -> DataFrame:
    """doc_id, p, q, source_id, _p and _q of open pairs (key, doc_id, p, q) and the pairs of earlier documents (key, source_id, _p, _q).

    A pair that n documents ask for and m have makes n * m rows. Up to each * (n + m) they are joined; beyond it blocks of either side
    meet, and the chains of every document with every earlier source are aligned there, as chained() and aligned() do it later. Rows go on
    only for the first source of a block with given start, end, edits and equal words beside them (in steps of AROUND), and for
    sources that also have a pair joined one by one. So rows don't grow with n * m, and all spans are found that all rows would give."""
    n, m = (x.groupBy("key").agg(F.count("*").alias(c)) for x, c in ((open_, "n"), (sources, "m")))
    hot = written(n.join(m, "key").where(F.col("n") * F.col("m") > each * (F.col("n") + F.col("m"))).select("key"), "hot")
    both = open_.join(hot, "key", "left_anti").join(sources, "key").where("source_id < doc_id").select("doc_id", "p", "q", "source_id", "_p", "_q")

    def side(rows: DataFrame, name: str) -> DataFrame:
        """key of each frequent pair of a document, with its id, all its pairs, and its codes from lo on."""
        marked = rows.toDF("key", "id", "p", "q").join(hot.withColumn("hot", F.lit(True)), "key", "left").withColumn("hot", F.col("hot").isNotNull())
        docs = marked.groupBy("id").agg(F.collect_list(F.struct("key", "p", "q", "hot")).alias("pairs"), F.min("p").alias("p"), F.max("q").alias("q")).where(F.exists("pairs", lambda x: x["hot"]))
        lo = F.greatest(F.col("p") - MARGIN, F.lit(0))
        docs = docs.join(codes, "id").select("id", "pairs", lo.alias("lo"), F.substring("codes", 2 * lo + 1, 2 * (F.col("q") + k + MARGIN - lo)).alias("codes"))
        docs = written(docs.withColumn("at", F.array_distinct(F.transform(F.filter("pairs", lambda x: x["hot"]), lambda x: x["key"]))), name)
        return docs.withColumn("key", F.explode("at")).drop("at")

    def blocks(docs: DataFrame, part: str, most: int) -> DataFrame:
        weight = F.sum(F.length("codes") + 32 * F.size("pairs"))
        return docs.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / most), F.ceil(weight / BLOCK_BYTES)).cast("int").alias(part))

    def run(at: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        left, right = Side(a), Side(b)
        x, y = met(at[0].as_py(), left, right, k, max_gap)
        return pa.table({"doc_id": left.ids[left.row[x]], "p": left.p[x], "q": left.q[x], "source_id": right.ids[right.row[y]], "_p": right.p[y], "_q": right.q[y]})

    docs, others = side(open_, "asking"), side(sources, "having")
    counts = written(blocks(docs, "rows", BLOCKS[0]).join(blocks(others, "columns", BLOCKS[1]), "key"), "blocks")
    own, every = lambda of: F.pmod(F.xxhash64("id"), F.col(of)).cast("int"), lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    at = ["key", "row", "column"]
    a = docs.join(counts, "key").select("key", own("rows").alias("row"), every("columns").alias("column"), "id", "pairs", "lo", "codes")
    b = others.join(counts, "key").select("key", every("rows").alias("row"), own("columns").alias("column"), "id", "pairs", "lo", "codes")
    more = a.groupBy(*at).cogroup(b.groupBy(*at)).applyInArrow(run, "doc_id bigint, p int, q int, source_id bigint, _p int, _q int")
    return both.unionByName(more)


def rest_matches(seen: DataFrame, spans: DataFrame, codes: DataFrame, k: int, window: int, min_words: int, max_gap: int) -> DataFrame:
    """As matches(), of a document and every earlier one, not the first alone, that has two of its seeds near each other that no one span holds.

    A chain holds two seeds at most max_gap words apart in both texts. So pairs of such seeds tell all documents that
    a chain can have as its source; pairs inside one span have theirs. Pairs count where repeated seeds, a window more on
    either side, reach over min_words words, as a passage needs them. Of equal texts the first one stands for all.
    For pairs that very many documents have see pair_matches()."""
    at = F.collect_list(F.struct("pos", "seed")).alias("at")
    held = spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("held"))
    later = seen.where(F.col("doc_id") != F.col("source_id")).groupBy("doc_id").agg(at).where(F.size("at") > 1)
    open_ = written(keyed(later.join(held, "doc_id", "left"), k, window, max_gap, max(1, min_words - k - 2 * (window - 1))), "open")
    ends = open_.select("doc_id", F.explode(F.array("p", "q")).alias("pos")).distinct()
    wanted = written(seen.join(ends, ["doc_id", "pos"], "left_semi").select("seed").distinct(), "wanted")
    first = codes.groupBy(F.md5("codes")).agg(F.min("id").alias("doc_id")).select("doc_id")
    sources = keyed(seen.join(wanted, "seed", "left_semi").groupBy("doc_id").agg(at).where(F.size("at") > 1).join(first, "doc_id", "left_semi"), k, window, max_gap)
    keys = written(open_.select("key").distinct(), "keys")
    sources = sources.join(keys, "key", "left_semi").select("key", F.col("doc_id").alias("source_id"), F.col("p").alias("_p"), F.col("q").alias("_q"))
    sources = written(sources, "sources")
    both = pair_matches(open_, sources, codes, k, EACH, max_gap)
    each = both.select("doc_id", "source_id", F.inline(F.array(F.struct(F.col("p").alias("pos"), F.col("_p").alias("source_pos")), F.struct(F.col("q").alias("pos"), F.col("_q").alias("source_pos")))))
    return each.select("doc_id", "pos", "source_id", "source_pos").distinct()


def added(rest: DataFrame, spans: DataFrame) -> DataFrame:
    """The spans of rest that no one of spans holds; of those with the same ends that of the first source."""
    held = spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("_held"))
    new = rest.join(held, "doc_id", "left").where(F.col("_held").isNull() | ~F.exists("_held", lambda x: (x["start"] <= F.col("start")) & (F.col("end") <= x["end"])))
    one = new.groupBy("doc_id", "start", "end").agg(F.min(F.struct("source_id", "source_start", "source_end", "edits")).alias("_one"))
    return one.select("doc_id", "start", "end", "_one.*").select(*spans.columns)


def diagonals(a: np.ndarray, b: np.ndarray, k: int, max_gap: int) -> np.ndarray:
    """Matches as rows (start in a, start in b, length): those of a diagonal without a larger gap become one."""
    order = np.lexsort((a, a - b))
    a, b = a[order], b[order]
    new = np.concatenate([[True], (np.diff(a - b) != 0) | (np.diff(a) > max_gap + k)])
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(a)) - 1
    return np.stack([a[at], b[at], a[ends] + k - a[at]], axis=1)


def chain(parts: np.ndarray, gap_cost: float) -> list[list[int]]:
    """Collinear chains of parts (see diagonals()), the best first; each part is in one chain.

    The best chain that ends in part i adds to i the best of the parts that end before it
    in both texts. The cost of the words between splits into a term of either part, so that
    a Fenwick tree of running maxima over the ends in b gives it."""
    if len(parts) == 1:
        return [[0]]
    start_a, start_b, size = parts.T
    ends = np.unique(start_b + size)
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (len(ends) + 1)
    slot = np.searchsorted(ends, start_b + size) + 1
    upto = np.searchsorted(ends, start_b, "right")
    score, before = size.astype(float), np.full(len(parts), -1)
    # parts are asked in the order of their starts, put in in the order of their ends
    events = sorted([(int(s), 1, i) for i, s in enumerate(start_a)] + [(int(e), 0, i) for i, e in enumerate(start_a + size)])
    for _, ask, i in events:
        if ask:
            best, at = -np.inf, int(upto[i])
            while at:
                best = max(best, tree[at], key=lambda x: x[0]) if best != -np.inf else tree[at]
                at -= at & -at
            if best != -np.inf and best[1] >= 0 and (gain := best[0] - gap_cost * (start_a[i] + start_b[i])) > 0:
                score[i] += gain
                before[i] = best[1]
        else:
            value, at = (score[i] + gap_cost * (start_a[i] + start_b[i] + 2 * size[i]), i), int(slot[i])
            while at < len(tree):
                if value[0] > tree[at][0]:
                    tree[at] = value
                at += at & -at
    used, found = np.zeros(len(parts), bool), []
    for i in np.argsort(-score, kind="stable"):
        own = []
        while i >= 0 and not used[i]:
            used[i] = True
            own.append(int(i))
            i = before[i]
        if own:
            found.append(own[::-1])
    return found


def pieces(parts: np.ndarray, k: int, max_gap: int, least: int) -> Iterator[np.ndarray]:
    """The chains of parts (see diagonals()), cut where more than max_gap words are between two, with `least` seeds or more."""
    for own in chain(parts, GAP_COST):
        rows = parts[own]
        far = (rows[1:, 0] - rows[:-1, 0] - rows[:-1, 2] > max_gap) | (rows[1:, 1] - rows[:-1, 1] - rows[:-1, 2] > max_gap)
        for piece in np.split(rows, np.flatnonzero(far) + 1):
            if least == 1 or len(piece) > 1 or piece[0, 2] > k:
                yield piece


def chained(found: DataFrame, k: int, max_gap: int, least: int = 2) -> DataFrame:
    """doc_id, source_id and parts (start, source start and length of each, flat) of the chains of at least `least` seeds (1 or 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of_pair(doc: int, source: int, a: np.ndarray, b: np.ndarray) -> None:
            out.extend((doc, source, x.ravel().astype(np.int32)) for x in pieces(diagonals(a, b, k, max_gap), k, max_gap, least))

        rest = None
        out: list = []

        def flush() -> pa.RecordBatch:
            r = pa.record_batch({"doc_id": pa.array([x[0] for x in out], pa.int64()), "source_id": pa.array([x[1] for x in out], pa.int64()), "parts": pa.array([x[2] for x in out], pa.list_(pa.int32()))})
            out.clear()
            return r

        for b in batches:  # sorted by pair; the last pair of a batch can go on in the next one
            now = [b[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "source_id", "pos", "source_pos")]
            now = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
            cuts = np.flatnonzero((np.diff(now[0]) != 0) | (np.diff(now[1]) != 0)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            for lo, hi in zip([0, *cuts[:-1]], cuts, strict=False):
                if hi - lo >= least:
                    of_pair(int(now[0][lo]), int(now[1][lo]), now[2][lo:hi], now[3][lo:hi])
            rest = [x[last:] for x in now]
            if out:
                yield flush()
        if rest is not None and len(rest[0]) >= least:
            of_pair(int(rest[0][0]), int(rest[1][0]), rest[2], rest[3])
            if out:
                yield flush()

    ordered = found.repartition("doc_id").sortWithinPartitions("doc_id", "source_id")
    return ordered.mapInArrow(run, "doc_id bigint, source_id bigint, parts array<int>")


def reach(same: np.ndarray) -> int:
    """How far to extend over a run of equal (True) and unequal words: to the best score before it falls by more than 8."""
    if not len(same):
        return 0
    score = np.cumsum(np.where(same, 1, -3))
    fallen = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score > 8)
    score = score[: fallen[0]] if len(fallen) else score
    best = int(score.argmax()) if len(score) else 0
    return best + 1 if len(score) and score[best] > 0 else 0


def edits(a: np.ndarray, b: np.ndarray) -> int:
    """Edit distance of two short word sequences."""
    if not len(a) or not len(b):
        return max(len(a), len(b))
    row, steps = np.arange(len(b) + 1), np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        up = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        # insertions run along the row: a running minimum of what is left after their cost
        row = np.minimum.accumulate(np.concatenate([[i], up]) - steps) + steps
    return int(row[-1])


def align(parts: np.ndarray, a: np.ndarray, a0: int, b: np.ndarray, b0: int) -> tuple[int, int, int, int, int]:
    """Start and end in either text, and edits, of a chain. a, b: word codes from places a0 and b0 on."""
    rows = parts.reshape(-1, 3)
    (sa, sb, _), (ea, eb, size) = rows[0], rows[-1]
    n = min(sa - a0, sb - b0, MARGIN)
    back = reach((a[sa - a0 - n : sa - a0] == b[sb - b0 - n : sb - b0])[::-1])
    ea, eb = ea + size, eb + size
    n = min(a0 + len(a) - ea, b0 + len(b) - eb, MARGIN)
    on = reach(a[ea - a0 : ea - a0 + n] == b[eb - b0 : eb - b0 + n])
    wrong, at_a, at_b = 0, sa - back, sb - back
    for pa_, pb_, n in [*rows.tolist(), (ea + on, eb + on, 0)]:
        wrong += edits(a[at_a - a0 : pa_ - a0], b[at_b - b0 : pb_ - b0]) if pa_ - at_a != pb_ - at_b else int((a[at_a - a0 : pa_ - a0] != b[at_b - b0 : pb_ - b0]).sum())
        wrong += int((a[pa_ - a0 : pa_ - a0 + n] != b[pb_ - b0 : pb_ - b0 + n]).sum())
        at_a, at_b = pa_ + n, pb_ + n
    return sa - back, at_a, sb - back, at_b, wrong


def word_codes(read: DataFrame) -> DataFrame:
    """id and codes, two bytes a word."""
    # as a table, so that a source with very many chains can be split over tasks
    return written(read.groupBy(F.col("doc_id").alias("id")).agg(F.max("codes").alias("codes")), "codes")


def aligned(chains: DataFrame, codes: DataFrame, min_part: int, similarity: float) -> DataFrame:
    """doc_id, start, end, source_id, source_start, source_end and edits of the chains that are long and alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, source, parts, a, a0, c, c0 in zip(*(b[x].to_pylist() for x in ("doc_id", "source_id", "parts", "a", "a0", "b", "b0")), strict=True):
                s, e, t, u, wrong = align(np.array(parts), np.frombuffer(a, "<u2"), a0, np.frombuffer(c, "<u2"), c0)
                if e - s >= min_part and wrong <= (1 - similarity) * (e - s):
                    out.append((doc, s, e, source, t, u, wrong))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "start", "end", "source_id", "source_start", "source_end", "edits"])

    n = F.size("parts")
    firsts = F.col("parts")
    lo = lambda i: F.greatest(F.get(firsts, F.lit(i)) - MARGIN, F.lit(0))
    hi = lambda i: F.get(firsts, n - 3 + i) + F.get(firsts, n - 1) + MARGIN
    one = chains.join(codes.withColumnRenamed("id", "doc_id"), "doc_id").select("doc_id", "source_id", "parts", lo(0).alias("a0"), F.substring("codes", 2 * lo(0) + 1, 2 * (hi(0) - lo(0))).alias("a"))
    two = one.join(codes.withColumnRenamed("id", "source_id"), "source_id").select("doc_id", "source_id", "parts", "a0", "a", lo(1).alias("b0"), F.substring("codes", 2 * lo(1) + 1, 2 * (hi(1) - lo(1))).alias("b"))
    return two.mapInArrow(run, "doc_id bigint, start int, end int, source_id bigint, source_start int, source_end int, edits int")


def passages(docs: DataFrame, k: int = 5, window: int = 10, min_words: int = 50, min_part: int = 15, max_gap: int = 20, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, end (words of the passage), n_sources, source_id, source_start, source_end and edits of the longest span in it,
    and spans: start, end, source_id, source_start, source_end and edits of every span in it, in order."""
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    read = read_words(docs, k, window)
    seen, codes = written(matches(seed_table(read)), "seen"), word_codes(read)
    spans = written(aligned(chained(seen.where(F.col("doc_id") != F.col("source_id")), k, max_gap), codes, min_part, similarity), "spans")
    runs = run_matches(written(repeated(seen, spans, codes, k, window, min_words), "repeated"), min_words)
    spans = written(spans.unionByName(aligned(chained(runs, min_words, 0, 1), codes, min_part, similarity)), "spans")
    rest = aligned(chained(rest_matches(seen, spans, codes, k, window, min_words, max_gap), k, max_gap), codes, min_part, similarity)
    spans = spans.unionByName(added(rest, spans))
    by_doc = Window.partitionBy("doc_id").orderBy("start", "end", "source_id", "source_start")
    before = F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)).withColumn("passage", F.sum("new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    longest = F.max_by(F.struct("source_id", "source_start", "source_end", "edits"), F.struct(F.col("end") - F.col("start"), -F.col("source_id"), -F.col("start"), -F.col("source_start")))
    return (
        marked.groupBy("doc_id", "passage")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count_distinct("source_id").alias("n_sources"), longest.alias("longest"), F.sort_array(F.collect_set(F.struct("start", "end", "source_id", "source_start", "source_end", "edits"))).alias("spans"))
        .where(F.col("end") - F.col("start") >= min_words)
        .select("doc_id", "start", "end", "n_sources", "longest.*", "spans")
    )
