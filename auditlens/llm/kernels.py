"""Vectorised word and window hashing for use inside Spark tasks.

A *word* is a maximal run of characters other than space and ``\\t..\\r``
(``[^\\x20\\x09-\\x0D]+``), found on the UTF-8 bytes.  Each word gets a 64-bit
polynomial hash; windows of words get one or two 64-bit hashes.  All work is
on flat numpy arrays over a bounded number of documents at a time, so memory
follows ``CHUNK_BYTES`` plus the longest single document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)  # odd, so invertible mod 2^64

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer: spreads every input bit over the 64 output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@cache
def _byte_values() -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASES[0]))
    v[_IS_SPACE] = 0
    return v


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64; the table grows by doubling and is kept."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        full = np.full(size, base & (2**64 - 1), dtype=np.uint64)
        full[0] = 1
        have = _POWERS[base] = np.cumprod(full, dtype=np.uint64)
    return have[:n]


@cache
def _inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def hash_words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts ``data[cuts[i]:cuts[i+1]]`` (UTF-8 bytes).

    Returns byte starts, byte ends (relative to ``data``) and word hashes.
    A long text is cut at spaces into pieces of about ``CHUNK_BYTES``.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    word = ~_IS_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    at = cuts[(cuts > 0) & (cuts < n)]
    first[at] = word[at]
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    values, i = _byte_values(), 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, base + CHUNK_BYTES)))
        stop = ends[j - 1]
        v = values[data[base:stop]] * _powers(_BASES[0], stop - base)
        hashes[i:j] = np.add.reduceat(v, starts[i:j] - base) * _powers(_inverse(_BASES[0]), stop - base)[starts[i:j] - base]
        i = j
    return starts, ends, mix(hashes ^ (ends - starts).astype(np.uint64))


def hash_windows(words: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """Hash of ``words[i:i+size]`` for every i (empty when there are fewer words)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = _BASES[seed]
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words + _U(seed)) * _powers(base, len(words)), out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * _powers(_inverse(base), n))


def hash_spans(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, seed: int = 1) -> np.ndarray:
    """Hash of ``words[lo:hi]`` for arrays of bounds."""
    base = _BASES[seed]
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words + _U(seed)) * _powers(base, len(words)), out=sums[1:])
    return mix((sums[hi] - sums[lo]) * _powers(_inverse(base), len(words) + 1)[lo])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` (``CHUNK_BYTES``) of text each (one row at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (size or CHUNK_BYTES), side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words_of(data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of rows i..j: hashes, byte starts, byte ends, and bounds (row r of the range owns words bounds[r]:bounds[r+1])."""
    base = offsets[i]
    cuts = offsets[i:j + 1] - base
    starts, ends, hashes = hash_words(data[base:offsets[j]], cuts)
    return hashes, starts + base, ends + base, np.searchsorted(starts, cuts)


def covered(marks: np.ndarray, size: int, n: int) -> np.ndarray:
    """Positions 0..n-1 covered by a window of ``size`` that starts where ``marks`` is true."""
    delta = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(marks)
    np.add.at(delta, at, 1)
    np.add.at(delta, np.minimum(at + size, n), -1)
    return np.cumsum(delta[:n]) > 0
