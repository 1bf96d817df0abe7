"""Elias-Fano sequences and files of arrays that are mapped, not loaded."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
from pyarrow import fs as pafs

WORD = np.uint64(64)
#: For each byte and rank: where the bit of that rank is.
IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.int64)


def _place(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Where the set bit of a rank (from 0) is in each word: set bits up to each byte, all eight in one number, tell the byte, a table the bit."""
    ones, high = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
    rank = rank.astype(np.uint64)
    pairs = words - ((words >> np.uint64(1)) & np.uint64(0x5555555555555555))
    fours = (pairs & np.uint64(0x3333333333333333)) + ((pairs >> np.uint64(2)) & np.uint64(0x3333333333333333))
    upto = ((fours + (fours >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * ones
    before = np.bitwise_count(((rank * ones) | high) - upto & high).astype(np.uint64) << np.uint64(3)
    left = rank - (((upto << np.uint64(8)) >> before) & np.uint64(255))
    return before.astype(np.int64) + IN_BYTE[((words >> before) & np.uint64(255)).astype(np.int64), left.astype(np.int64)]


@dataclass
class EliasFano:
    """A sequence of n numbers that never fall: the upper bits in unary, the lower `low_bits` packed."""

    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    ones: np.ndarray  # set bits before each word of high
    zeros: np.ndarray

    @staticmethod
    def arrays(values: np.ndarray) -> tuple[int, dict[str, np.ndarray]]:
        """low_bits and the arrays for a sequence of uint64."""
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, int(np.floor(np.log2((top + 1) / n)))) if n else 0
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(at[-1]) if n else 0) // 64 + 2, np.uint64)
        np.bitwise_or.at(high, at // 64, np.uint64(1) << (at % 64).astype(np.uint64))
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            v, start = values & np.uint64((1 << bits) - 1), np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (start // WORD).astype(np.int64), start % WORD
            np.bitwise_or.at(low, word, v << shift)
            over = shift + np.uint64(bits) > WORD
            np.bitwise_or.at(low, word[over] + 1, v[over] >> (WORD - shift[over]))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        return bits, {"low": low, "high": high, "ones": ones.astype(np.uint32), "zeros": (np.arange(len(ones)) * 64 - ones).astype(np.uint32)}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        start = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (start // WORD).astype(np.int64), start % WORD
        value = self.low[word] >> shift
        over = shift + np.uint64(self.low_bits) > WORD
        value[over] |= self.low[word[over] + 1] << (WORD - shift[over])
        return value & np.uint64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The numbers at indices."""
        word = np.searchsorted(self.ones, i.astype(np.uint32), "right") - 1
        at = word * 64 + _place(self.high[word], i - self.ones[word].astype(np.int64))
        return ((at - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Where the zero of a rank is in the upper bits; -1 for rank -1."""
        out = np.full(len(k), -1, np.int64)
        real = k >= 0
        kk = k[real]
        word = np.searchsorted(self.zeros, kk.astype(np.uint32), "right") - 1
        out[real] = word * 64 + _place(~self.high[word], kk - self.zeros[word].astype(np.int64))
        return out

    def find(self, x: np.ndarray) -> np.ndarray:
        """The first index of each number, -1 where it is not in the sequence."""
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        h = (x >> np.uint64(self.low_bits)).astype(np.int64)
        known = np.flatnonzero(h < int(self.zeros[-1]))  # further up there are no numbers
        h = h[known]
        at = self._zero(h - 1) + 1
        rest = self.high[at >> 6] >> (at & 63).astype(np.uint64)
        # the set bits from here on: their zero is in the same word as a rule
        end = at + np.bitwise_count(rest & ~(rest + np.uint64(1)))
        further = np.flatnonzero(end >> 6 != at >> 6)
        end[further] = self._zero(h[further])
        lo, end = at - h, end - h
        want, hi = x[known] & np.uint64((1 << self.low_bits) - 1), end.copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            middle = (lo[open_] + hi[open_]) // 2
            less = self._low(middle) < want[open_]
            lo[open_[less]] = middle[less] + 1
            hi[open_[~less]] = middle[~less]
        there = lo < end
        there[there] = self._low(lo[there]) == want[there]
        out[known[there]] = lo[there]
        return out


def save(folder: str, arrays: dict[str, np.ndarray]) -> tuple[str, dict[str, tuple[str, int, int]]]:
    """Writes arrays to a new file in a folder that all machines share; its address, and dtype, place and length of each."""
    store, path = pafs.FileSystem.from_uri(folder)
    name, layout, at = f"{uuid.uuid4().hex}.bin", {}, 0
    store.create_dir(path)
    with store.open_output_stream(f"{path}/{name}") as f:
        for key, a in arrays.items():
            data = np.ascontiguousarray(a).tobytes()
            data += b"\0" * (-len(data) % 8)
            layout[key] = (a.dtype.str, at, len(a))
            f.write(data)
            at += len(data)
    return f"{folder}/{name}", layout


_mapped: dict[str, np.memmap] = {}


def mapped(address: str, layout: dict[str, tuple[str, int, int]], key: str) -> np.ndarray:
    """An array of a saved file, mapped into memory. A file of a store that can't be mapped is copied to an unnamed local file first."""
    if address not in _mapped:
        if len(_mapped) > 4096:
            _mapped.clear()
        store, path = pafs.FileSystem.from_uri(address)
        if isinstance(store, pafs.LocalFileSystem):
            _mapped[address] = np.memmap(path, np.uint8, "r")
        else:
            local = tempfile.TemporaryFile()
            with store.open_input_stream(path) as f:
                shutil.copyfileobj(f, local)
            local.flush()
            _mapped[address] = np.memmap(local, np.uint8, "r")
    kind, at, n = layout[key]
    kind = np.dtype(kind)
    return np.asarray(_mapped[address][at : at + n * kind.itemsize]).view(kind)
