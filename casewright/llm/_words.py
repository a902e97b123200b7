"""Byte-level word kernels shared by the Arrow operators.

Texts stay UTF-8 bytes: ``bytes.lower`` lowers A-Z alone and ``bytes.split`` cuts at
exactly 0x20 and 0x09-0x0D, which is the word rule of the contracts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Fixed odd multipliers of the shingle hash and its finaliser (64-bit mixing constants).
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_CACHE_WORDS = 200_000


class WordHashes(dict):
    """word bytes -> 64-bit hash, remembered for up to ``_CACHE_WORDS`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


#: Rows of an Arrow batch turned into Python objects at a time; batches of long texts would fill a worker otherwise.
_SLICE = 256


def strings_of(column: pa.Array):
    """The column's texts one by one, None where null."""
    for at in range(0, len(column), _SLICE):
        yield from column.slice(at, _SLICE).to_pylist()


def texts_of(column: pa.Array):
    """The column's texts one by one as UTF-8 bytes, None where null."""
    kind = pa.binary() if pa.types.is_string(column.type) else pa.large_binary()
    for at in range(0, len(column), _SLICE):
        yield from column.slice(at, _SLICE).cast(kind).to_pylist()


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX[0]
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX[1]
    return h ^ (h >> np.uint64(33))


def shingle_hashes(words: list[bytes], hashes: WordHashes, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word k-shingles; fewer words: the whole sequence as one; none: empty."""
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=n)
    m = min(n, k)
    with np.errstate(over="ignore"):
        h = w[: n - m + 1].copy()
        for i in range(1, m):
            h *= _MUL
            h += w[i : n - m + 1 + i]
        return np.unique(mix(h + np.uint64(m)))
