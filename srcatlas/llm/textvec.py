"""Vectorised text work on Arrow string columns: lower-casing, words, word and shingle hashes.

A batch of documents is one byte buffer with document offsets, so no step loops over words.
Hashes are polynomials modulo 2**64 taken from prefix sums and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (BASE, pow(BASE, -1, 2**64)):
        p = np.full(size, b, dtype=U)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i up to n, from a table of a power-of-two size."""
    return _powers(max(1 << 21, 1 << (n + 1).bit_length()))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of (byte + 1) * BASE**position before i; P[0] = 0."""
    out = np.zeros(len(data) + 1, dtype=U)
    x = data.astype(U)
    x += U(1)
    x *= powers(len(data))[0][: len(data)]
    np.cumsum(x, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] whatever its place; equal bytes have equal hashes."""
    inv = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its texts reach about `most` bytes, so that arrays stay in cache; one text is never cut."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


#: ASCII capitals to small letters; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: letters and digits of ASCII and every byte of other characters.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
#: Bytes of words that ASCII white space alone divides.
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False


class Words:
    """Words of a batch: start, end, hash; ptr[d]:ptr[d+1] are the words of document d. word: the bytes that words consist of."""

    def __init__(self, column: pa.Array, word: np.ndarray = WORD):
        data, self.offsets = utf8(column)
        self.low = low = LOWER[data]
        is_word = word[low]
        before = np.empty(len(low), bool)
        if len(low):
            before[0] = False
            before[1:] = is_word[:-1]
            cuts = self.offsets[:-1]
            before[cuts[cuts < len(low)]] = False
        self.start = np.flatnonzero(is_word & ~before)
        after = np.empty(len(low), bool)
        if len(low):
            after[-1] = False
            after[:-1] = is_word[1:]
            cuts = self.offsets[1:] - 1
            after[cuts[cuts >= 0]] = False
        self.end = np.flatnonzero(is_word & ~after) + 1
        self.prefix = prefix_hash(low)
        self.hash = span_hash(self.prefix, self.start, self.end)
        self.ptr = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(len(column)), np.diff(self.ptr))

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of runs of n words and the index of each run's first word; runs stay inside a document."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64)
        h = self.hash[:m].copy()
        for i in range(1, n):
            h *= U(BASE)
            h += self.hash[i : m + i]
        first = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return mix(h[first]), first


def shingle_sets(column: pa.Array, words: int, word: np.ndarray = WORD) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, and the hash, first word and document pointer of all shingles; a short text is one shingle."""
    w = Words(column, word)
    h, first = w.shingles(words)
    count = np.diff(w.ptr)
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        own = np.array([_one(w.hash[w.ptr[d] : w.ptr[d + 1]]) for d in short], U)
        h, first = np.concatenate([h, own]), np.concatenate([first, w.ptr[short]])
        order = np.argsort(first, kind="stable")
        h, first = h[order], first[order]
    return w, h, first, np.searchsorted(first, w.ptr)


def _one(hashes: np.ndarray) -> np.uint64:
    out = U(len(hashes))
    with np.errstate(over="ignore"):
        for x in hashes:
            out = out * U(0x9E3779B97F4A7C15) + x
    return mix(np.array([out]))[0]


def permuted(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th permutation's value of each hash, 32 bits."""
    a, b = mix(np.array([2 * k + 1, 2 * k + 2], U))
    return ((h * (a | U(1)) + b) >> U(32)).astype(np.uint32)
