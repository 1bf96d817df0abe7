"""SentencePiece encoding and decoding with shared-prefix Viterbi.

A text is marked (a space becomes U+2581, one more goes in front) and cut where no piece
can reach across: before each run of marks, around characters that stand in no longer
piece, and between letters and other characters if no piece has both. The distinct marked
words of a chunk of texts are sorted, which makes their shared prefixes neighbours, and
the implied trie is walked depth first: the forward state of a prefix is worked out once
and serves all words below it.

The forward state of a prefix is the last piece of its best segmentation, with the score
so far. For a unigram model that is Viterbi's own rule, the best sum of piece scores. For
a model whose pieces come from merges, a sum of scores would not give the model's own
segmentation, so the state is ruled by agreement instead: the last piece is the one that
merging leaves as it is beside the last piece of the prefix before it, and there is just
one; no scores are added up. The result equals the library's own encode() either way.
Characters without a piece become byte pieces where the model has them, else the unknown
piece.

Decoding joins pieces and bytes and turns marks into spaces. It gives back the text, but
for U+2581 itself, which decodes to a space. A null text has null ids and decodes to
null; an empty one has no ids. Texts of any length are encoded whole and rows don't depend
on each other, so repeated rows get equal ids. A column of the input named token_ids or
decoded_text gives way to the result's.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from coverscope.llm.shared import chunks, schema_of

MARK = "▁"
UNIGRAM, MERGES = 1, 2
#: The vocabulary goes to every executor: a larger model file is refused.
MAX_MODEL_BYTES = 64 << 20
CHUNK_BYTES = 4_000_000
#: Words that a worker keeps (twice as many at most), pairs of pieces, and endings of KEY characters.
MAX_CACHED, MAX_AGREED, MAX_ENDINGS = 100_000, 500_000, 150_000
KEY = 4


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    ids: dict[str, int]  # of the pieces that can stand in a segmentation
    byte_ids: list[int] | None
    unknown: int
    kind: int
    prefix: bool
    #: Of each piece that segmentations really have: its id, and which pieces stand in front of it (see agrees()), -1 always
    usable: dict[str, tuple[int, dict[int, bool]]] = field(default_factory=dict)
    longer: dict[str, list[int]] = field(default_factory=dict)  # by the last KEY characters of longer pieces: their lengths, the longest first
    endings: dict[str, list[tuple]] = field(default_factory=dict)
    n_agreed: int = 0
    units: re.Pattern = re.compile("")  # a marked text's words
    halves: dict[str, tuple[str, str]] = field(default_factory=dict)  # the two parts that a piece is merged of at last

    def __post_init__(self):
        self.usable = {p: (i, {-1: True}) for p, i in self.ids.items() if self.kind == UNIGRAM or self.merged(p) == [i]}
        longer: dict[str, set[int]] = {}
        for p in self.usable:
            if len(p) > KEY:
                longer.setdefault(p[-KEY:], set()).add(len(p))
        self.longer = {k: sorted(x, reverse=True) for k, x in longer.items()}
        rest = [p for p in (p.lstrip(MARK) for p in self.ids) if p]
        joined = {c for p in self.ids if len(p) > 1 for c in p.lstrip(MARK)}
        letters = {c for c in joined if c.isalpha()}
        kinds = (letters, joined - letters)
        if any(len({c in letters for c in p}) > 1 for p in rest):
            kinds = (joined, set())
        runs = [f"{MARK}*[{''.join(map(re.escape, sorted(k)))}]+" for k in kinds if k]
        self.units = re.compile("|".join([*runs, f"{MARK}+", "."]), re.S)

    def ending(self, end: str) -> list[tuple]:
        """What can be the last piece of a text by its last KEY characters (of a shorter one: by all), the longest first: length, id and known neighbours; longer ones have no id yet."""
        if len(self.endings) > MAX_ENDINGS:
            self.endings.clear()
        found = [(n, None, None) for n in self.longer.get(end, ())]
        found += [(n, *self.usable[end[-n:]]) for n in range(len(end), 0, -1) if end[-n:] in self.usable]
        self.endings[end] = found or [(1, None, None)]
        return found

    def merged(self, text: str) -> list[int]:
        """Pieces of a short text by merging: the best-scored adjacent pair first, the left one of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                p = self.ids.get(parts[i] + parts[i + 1])
                if p is not None and (best is None or self.scores[p] > best):
                    best, at = self.scores[p], i
            if at < 0:
                return [self.ids.get(p, self.unknown) for p in parts]
            if len(parts) == 2:
                self.halves[text] = (parts[0], parts[1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def agrees(self, left: int, right: int) -> bool:
        """Whether merging leaves two pieces side by side as they are. What is found is kept, up to a number of pairs.

        Only what stands at the seam can merge over it: from single characters on, the
        parts there grow into the pieces, the better-scored merge first. The seam holds if
        no two parts make a piece that scores better than what takes one of them up."""
        if self.n_agreed > MAX_AGREED:
            self.n_agreed = 0
            for _, known in self.usable.values():
                known.clear()
                known[-1] = True
        a, b = self._grown(self.pieces[left], 1), self._grown(self.pieces[right], 0)
        i = j = 0
        while True:
            up_a = self.scores[self.ids[a[i + 1]]] if i + 1 < len(a) else None
            up_b = self.scores[self.ids[b[j + 1]]] if j + 1 < len(b) else None
            p = self.ids.get(a[i] + b[j])
            # of equal scores the merge further left comes first
            if p is not None and (up_a is None or self.scores[p] > up_a) and (up_b is None or self.scores[p] >= up_b):
                agreed = False
                break
            if up_a is None and up_b is None:
                agreed = True
                break
            if up_b is None or up_a is not None and up_a >= up_b:
                i += 1
            else:
                j += 1
        self.usable[self.pieces[right]][1][left] = agreed
        self.n_agreed += 1
        return agreed

    def _grown(self, piece: str, side: int) -> list[str]:
        """The parts at one end of a piece (0: its start, 1: its end) while it is merged, from a single character on."""
        out = [piece]
        while len(piece) > 1:
            piece = self.halves[piece][side]
            out.append(piece)
        return out[::-1]


def load(path: str) -> Vocabulary:
    """The vocabulary of a model file."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(path, "rb") as f:
        data = f.read(MAX_MODEL_BYTES + 1)
    if len(data) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MAX_MODEL_BYTES} bytes")
    model = pb.ModelProto.FromString(data)
    kind, normal = model.trainer_spec.model_type, model.normalizer_spec
    if kind not in (UNIGRAM, MERGES) or normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces:
        raise ValueError(f"{path}: only unigram and merge models without text normalisation are supported")
    pieces, scores = [p.piece for p in model.pieces], [p.score for p in model.pieces]
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError(f"{path} has pieces that reach across words")
    plain = {p.piece: i for i, p in enumerate(model.pieces) if p.type == p.NORMAL}
    as_bytes = {p.piece: i for i, p in enumerate(model.pieces) if p.type == p.BYTE}
    return Vocabulary(
        pieces,
        scores,
        plain,
        [as_bytes[f"<0x{b:02X}>"] for b in range(256)] if len(as_bytes) == 256 else None,
        next(i for i, p in enumerate(model.pieces) if p.type == p.UNKNOWN),
        kind,
        normal.add_dummy_prefix,
    )


def encode_words(words: list[str], v: Vocabulary) -> Iterator[list[int]]:
    """The ids of each of the distinct words, in order; sorted ones share the work on their prefixes."""
    missing, unigram = min(v.scores) - 10, v.kind == UNIGRAM
    usable, endings, scores, length = v.usable, v.endings, v.scores, [len(p) for p in v.pieces]
    last: list[int] = [-1]  # of each prefix: its last piece, -1 if that is no piece
    total: list[float] = [0.0]  # and, for a unigram model, its best sum of scores
    before = ""
    for word in words:
        same = 0
        for a, b in zip(before, word, strict=False):
            if a != b:
                break
            same += 1
        del last[same + 1 :], total[same + 1 :]
        for end in range(same + 1, len(word) + 1):
            key = word[end - KEY : end] if end > KEY else word[:end]
            ways = endings.get(key) or v.ending(key)
            piece = -1
            if unigram:
                best = total[end - 1] + missing
                for n, p, _ in ways:
                    if p is None:
                        p = usable.get(word[end - n : end], (None,))[0] if n <= end else None
                    if p is not None and (score := total[end - n] + scores[p]) > best:
                        piece, best = p, score
                total.append(best)
            else:
                for n, p, known in ways:
                    if p is None:
                        if n > end or (found := usable.get(word[end - n : end])) is None:
                            continue
                        p, known = found
                    ok = known.get(last[end - n])
                    if ok or ok is None and v.agrees(last[end - n], p):
                        piece = p
                        break
            last.append(piece)
        ids: list[int] = []
        end = len(word)
        while end:
            piece = last[end]
            if piece >= 0:
                ids.append(piece)
                end -= length[piece]
                continue
            if v.byte_ids is None:
                ids.append(v.unknown)
            else:
                ids.extend(v.byte_ids[b] for b in reversed(word[end - 1].encode()))
            end -= 1
        ids.reverse()
        before = word
        yield ids


class Words(dict):
    """The number of each word met."""

    def __init__(self, older: Words | None = None):
        super().__init__()
        self.older, self.new = older, []
        self.flat, self.starts, self.sizes = array("i"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.new.append(word)
        return at


class Encoder:
    """Encodes chunks of texts. Words found out are kept in two generations: what the younger one doesn't meet again is forgotten with the older one."""

    def __init__(self, v: Vocabulary):
        self.v, self.words = v, Words()

    def cut(self, text: str) -> list[str]:
        text = text.replace(" ", MARK)
        return self.v.units.findall(MARK + text if self.v.prefix and text else text)

    def learn(self) -> None:
        """Encodes the words met anew."""
        w, older = self.words, self.words.older or {}
        met = [(k, older.get(k)) for k in w.new]
        moved, new = [x for x in met if x[1] is not None], sorted(k for k, at in met if at is None)
        w.new.clear()
        first, sizes = len(w.flat), []
        for _, at in moved:
            start, n = int(older.starts[at]), int(older.sizes[at])
            w.flat.extend(older.flat[start : start + n])
            sizes.append(n)
        for ids in encode_words(new, self.v):
            w.flat.extend(ids)
            sizes.append(len(ids))
        grown = np.zeros(len(w) - len(w.starts), np.int64)
        w.starts, w.sizes = np.concatenate([w.starts, grown]), np.concatenate([w.sizes, grown])
        at = np.array([w[k] for k, _ in moved] + [w[k] for k in new], np.int64)
        n = np.array(sizes, np.int64)
        w.starts[at], w.sizes[at] = first + np.cumsum(n) - n, n

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (one more at the end)."""
        if len(self.words) > MAX_CACHED:
            self.words.older = None
            self.words = Words(self.words)
        numbers, counts, number = [], [0], self.words.__getitem__
        for t in texts:
            if t is not None:
                numbers.extend(map(number, self.cut(t)))
            counts.append(len(numbers))
        self.learn()
        at = np.array(numbers, np.int64)
        n = self.words.sizes[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        where = np.repeat(self.words.starts[at] - ends[:-1], n) + np.arange(ends[-1])
        ids = np.frombuffer(self.words.flat, np.int32)[where] if len(where) else np.zeros(0, np.int32)
        return ids, ends[counts]


class Decoder:
    def __init__(self, v: Vocabulary):
        byte_of = {i: bytes([b]) for b, i in enumerate(v.byte_ids or [])}
        table = [byte_of.get(i) or (p.replace(MARK, " ").encode() if p in v.ids else b" \xe2\x81\x87 " if i == v.unknown else b"") for i, p in enumerate(v.pieces)]
        self.size = np.array([len(x) for x in table])
        self.start = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(table), np.uint8)
        self.spaced = np.array([x[:1] == b" " for x in table])
        self.is_byte = np.isin(np.arange(len(table)), v.byte_ids or [])
        self.prefix = v.prefix

    def decode(self, ids: np.ndarray, offsets: np.ndarray, valid: np.ndarray) -> pa.Array:
        """The texts of all rows. Bytes that make no character become U+FFFD."""
        start, size = self.start[ids], self.size[ids]
        if self.prefix:  # the space in front of the first word is no part of the text
            first = offsets[:-1][np.diff(offsets) > 0]
            first = first[self.spaced[ids[first]]]
            start[first] += 1
            size[first] -= 1
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.blob[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])] if len(ids) else self.blob[:0]
        rows = ends[offsets]
        if self.is_byte[ids].any():
            whole = data.tobytes()
            texts = [whole[a:b].decode("utf-8", "replace").replace(MARK, " ") if ok else None for a, b, ok in zip(rows[:-1], rows[1:], valid, strict=True)]
            return pa.array(texts, pa.string())
        bitmap = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
        return pa.StringArray.from_buffers(len(valid), pa.py_buffer(rows.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()), bitmap)


def _encoder(v: Vocabulary) -> Encoder:
    """The encoder of this worker: tasks that run on it one after another share its words."""
    if not hasattr(v, "encoder"):
        v.encoder = Encoder(v)
    return v.encoder


def _encoded(batch: pa.RecordBatch, text: str, e: Encoder) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """Slices of the batch: rows, ids, offsets, which texts there are, and the ids as a column."""
    for own in chunks(batch, text, CHUNK_BYTES):
        texts = own[text].to_pylist()
        ids, offsets = e.encode(texts)
        valid = np.array([t is not None for t in texts], bool)
        column = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=pa.array(~valid))
        yield own, ids, offsets, valid, column


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """docs with token_ids."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(shared.value)
        for b in batches:
            for own, _, _, _, column in _encoded(b, text, e):
                yield pa.RecordBatch.from_arrays([*own.columns, column], [*own.schema.names, "token_ids"])

    kept = docs.drop("token_ids")
    return kept.mapInArrow(run, f"{schema_of(kept)}, token_ids array<int>")


def decode(docs: DataFrame, model: str, ids: str = "token_ids") -> DataFrame:
    """docs with decoded_text."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Decoder(shared.value)
        for b in batches:
            column = b[ids]
            values, n = column.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(column), 0)
            offsets = np.concatenate([[0], np.cumsum(n.to_numpy(zero_copy_only=False), dtype=np.int64)])
            texts = d.decode(values.astype(np.int64), offsets, column.is_valid().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*b.columns, texts], [*b.schema.names, "decoded_text"])

    kept = docs.drop("decoded_text")
    return kept.mapInArrow(run, f"{schema_of(kept)}, decoded_text string")


def encode_and_decode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """docs with token_ids and decoded_text, which is made of the ids alone; as decode(encode()), in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, d = _encoder(shared.value), Decoder(shared.value)
        for b in batches:
            for own, ids, offsets, valid, column in _encoded(b, text, e):
                yield pa.RecordBatch.from_arrays([*own.columns, column, d.decode(ids, offsets, valid)], [*own.schema.names, "token_ids", "decoded_text"])

    kept = docs.drop("token_ids", "decoded_text")
    return kept.mapInArrow(run, f"{schema_of(kept)}, token_ids array<int>, decoded_text string")
