"""Vectorised text primitives over Arrow batches: words, spans and their hashes for many documents at once.

A chunk is a run of documents whose UTF-8 bytes lie side by side, with offsets; nothing here
loops over words. Chunks are cut by size, so memory is bounded whatever a batch holds; one
document longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_BYTES = np.arange(256)
IS_BLANK = np.isin(_BYTES, [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
IS_START = (_BYTES & 0xC0) != 0x80


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_words(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit words; the same on every machine."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15))


BYTE_WORDS = random_words(256, 1)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for i, base in enumerate((BASE, BASE_INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[i] = np.multiply.accumulate(row)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Chunk:
    """Documents lo to hi of a batch. data: their bytes; offsets: hi - lo + 1 places in it."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return self.hi - self.lo

    @cached_property
    def lowered(self) -> Chunk:
        return Chunk(self.lo, self.hi, LOWER[self.data], self.offsets)

    @cached_property
    def in_word(self) -> np.ndarray:
        return ~IS_BLANK[self.data]

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of True that don't cross documents."""
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        firsts = self.offsets[:-1]
        before[firsts[firsts < len(inside)]] = False
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        lasts = self.offsets[1:] - 1
        after[lasts[lasts >= 0]] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.runs(self.in_word)

    @cached_property
    def word_offsets(self) -> np.ndarray:
        """n + 1 places in words, one document after the other."""
        return np.searchsorted(self.words[0], self.offsets)

    @cached_property
    def prefix(self) -> np.ndarray:
        total = np.empty(len(self.data) + 1, np.uint64)
        total[0] = 0
        np.cumsum(BYTE_WORDS[self.data] * powers(len(self.data))[0], out=total[1:])
        return total

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of spans; equal spans have equal hashes anywhere."""
        inverse = powers(len(self.data) + 1)[1]
        return mix64((self.prefix[ends] - self.prefix[starts]) * inverse[starts])

    def per_document(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each document are flagged."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def shingles(self, size: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of size words and n + 1 places in them. whole: shorter texts with a word give one run of all words."""
        return shingle(self.hashes(*self.words), self.word_offsets, size, whole)


def shingle(words: np.ndarray, offsets: np.ndarray, size: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    counts = np.diff(offsets)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(counts) + 1, np.int64)
    factors = random_words(size, 7) | np.uint64(1)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    total = np.zeros(len(words), np.uint64)
    for k in range(size):
        total += padded[k : k + len(words)] * factors[k]
    long = counts >= size
    keep = np.zeros(len(words) + 1, np.int64)
    np.add.at(keep, offsets[:-1][long], 1)
    np.add.at(keep, offsets[1:][long] - size + 1, -1)
    flags = np.cumsum(keep[:-1]) > 0
    if whole:
        for i in np.flatnonzero((counts > 0) & ~long):
            a, b = offsets[i], offsets[i + 1]
            flags[a] = True
            total[a] = (words[a:b] * factors[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
    kept = np.zeros(len(words) + 1, np.int64)
    np.cumsum(flags, out=kept[1:])
    return mix64(total[flags]), kept[offsets]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The documents of a string column, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, places, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def concatenated(texts: list[bytes]) -> Chunk:
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return Chunk(0, len(texts), np.frombuffer(b"".join(texts), np.uint8), offsets)
