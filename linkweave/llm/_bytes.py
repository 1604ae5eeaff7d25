"""Vectorised text kernels: Arrow string buffers in, numpy arrays out, no Python string per word.

Texts are handled in blocks of about half a megabyte of whole documents, so working
arrays stay in cache and memory is bounded by the longest document.  Hashes are
64-bit polynomial hashes with random byte weights, mixed at the end; two given
different words collide with a probability of about 2**-60.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# The default pool keeps freed batches; a worker of an executor should give them back.
pa.set_memory_pool(pa.system_memory_pool())

U = np.uint64
BLOCK = 1 << 19
_rng = np.random.default_rng(20240607)
_WEIGHT = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WHITE = np.zeros(256, dtype=bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
_BASE = U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def lean(run):
    """A ``mapInArrow`` function that gives its worker's free memory back after each task and between batches."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                _trim()

        try:
            yield from run(fed())
        finally:
            _trim()

    return wrapped


def _trim() -> None:
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK + BLOCK // 4)
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK, most: int = 60_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``limit`` bytes, 1 to ``most`` rows each."""
    raw, offsets = buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n, i + most)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text) of the maximal runs of bytes that aren't white."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~WHITE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    begins[heads] = inside[heads]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    tails = heads[1:] - 1
    finish[tails] = inside[tails]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, offsets)


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Running weighted sum, from which ``span_hash`` takes any substring's hash."""
    c = np.empty(len(raw) + 1, np.uint64)
    c[0] = 0
    np.cumsum(_WEIGHT[raw] * _power(len(raw))[0], out=c[1:])
    return c


def span_hash(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    inverse = _power(len(running))[1]
    return mix((running[ends] - running[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, A-Z lower-cased."""
    return span_hash(prefix_hash(LOWER[raw]), starts, ends)


def shingles(w: np.ndarray, first: np.ndarray, size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every run of ``size`` words; a shorter text is one run of all its words."""
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    n = len(w)
    full = np.zeros(n, bool)
    if n >= size:
        full[: n - size + 1] = text[: n - size + 1] == text[size - 1 :]
    at = np.flatnonzero(full)
    h = np.full(len(at), size, np.uint64)
    for k in range(size):
        h = mix(h * U(0xD6E8FEB86659FD93) + w[at + k])
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        e = np.zeros(len(short), np.uint64)
        for i, t in enumerate(short):  # at most size - 1 words each
            x = np.array([count[t]], np.uint64)
            for v in w[first[t] : first[t + 1]]:
                x = mix(x * U(0xD6E8FEB86659FD93) + v)
            e[i] = x[0]
        h, of = np.concatenate([h, e]), np.concatenate([text[at], short])
    else:
        of = text[at]
    return h, of


def sort_within(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort by (text number, hash).  Text numbers stay below 65,536 in a block."""
    order = np.argsort(h)
    h, of = h[order], of[order]
    order = np.argsort(of.astype(np.uint16), kind="stable")
    return h[order], of[order]
