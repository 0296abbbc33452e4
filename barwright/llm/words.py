"""Hashes of words and word shingles, computed on Arrow buffers without a Python object per word."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240607)
_VALUE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_PLACE = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def give_back() -> None:
    """Returns memory that is free to the system. Workers live on after a task, and else hold what it took at most."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _INVERSE)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base of running hashes, and of its inverse."""
    power, inverse = _power(n)
    return power[:n], inverse[:n]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes of text, or one row."""
    return chunks_of(np.asarray(pc.fill_null(pc.binary_length(texts), 0)), limit)


def chunks_of(sizes: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to at most `limit`, or one row."""
    ends = np.cumsum(sizes, dtype=np.int64)
    begin = 0
    while begin < len(ends):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield begin, end
        begin = end


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of the texts and their offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return bytes_, at - at[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of non-white bytes, A-Z folded) and the bounds of each text's words."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    first, last = np.empty(n, bool), np.empty(n, bool)
    first[0], last[-1] = True, True
    first[1:], last[:-1] = space[:-1], space[1:]
    first[offsets[:-1][offsets[:-1] < n]] = True
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    begin, end = np.flatnonzero(first & ~space), np.flatnonzero(last & ~space)
    power, inverse = _power(n)
    value = _VALUE[data]
    value *= power[:n]
    np.cumsum(value, out=value)
    h = value[end]
    later = begin > 0
    h[later] -= value[begin[later] - 1]
    h *= inverse[begin]
    h += (end - begin).astype(np.uint64)
    return mix(h), np.searchsorted(begin, offsets)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The running hash of each k words in a row, as if all were one text."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += words[j : j + n] * _PLACE[j]
    return mix(out)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles, in order, and their bounds; a text of fewer words has them as one."""
    value, valid = np.zeros(len(words), np.uint64), np.ones(len(words), bool)
    full = window_hashes(words, k)
    value[: len(full)] = full
    begin, end = bounds[:-1], bounds[1:]
    for j in range(1, k):
        at = end - j
        valid[at[at >= begin]] = False
    short = np.flatnonzero((end > begin) & (end - begin < k))
    if len(short):
        at, n = begin[short], (end - begin)[short]
        v = n.astype(np.uint64)
        for j in range(k - 1):
            has = n > j
            v[has] += words[at[has] + j] * _PLACE[j + 32]
        value[at], valid[at] = mix(v), True
    count = np.zeros(len(words) + 1, np.int64)
    np.cumsum(valid, out=count[1:])
    return value[valid], count[bounds]


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values, sorted, and their bounds."""
    values = values.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[bounds[:-1][bounds[:-1] < len(values)]] = True
    count = np.zeros(len(values) + 1, np.int64)
    np.cumsum(new, out=count[1:])
    return values[new], count[bounds]


def shingle_sets(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text and their bounds."""
    return distinct(*shingle_hashes(*word_hashes(*buffers(texts)), k))
