"""Vectorised kernels over Arrow text columns (numpy, no per-character Python).

All kernels see whole texts. Memory is bounded by cutting batches into slices
of about ``MAX_BYTES`` of text, at document borders; one longer text makes a
slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MAX_BYTES = 1 << 19
U64 = np.uint64

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[32, *range(9, 14)]] = True
_TABLE = np.random.default_rng(20240501).integers(1, 2**64, 256, dtype=U64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 20:
            _powers[base] = have
    return have[:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = MAX_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with at most ``limit`` bytes each, or one document."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word ``[^\\x20\\x09-\\x0D]+``, and the first word of each document."""
    inside = ~_SEPARATOR[raw]
    n = len(raw)
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(raw) + 1, dtype=U64)
    np.cumsum(_TABLE[raw] * _power(_BASE, len(raw)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes in each span, the same wherever the span stands."""
    inverse = _power(_INVERSE, len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64))


def word_hashes(raw: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and the first word of each document."""
    raw = _FOLD[raw] if fold else raw
    starts, ends, first = words(raw, offsets)
    return span_hashes(prefix_sums(raw), starts, ends), first


def shingle_sets(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each document's n-word shingles, and their first positions.

    A document with fewer than n words, but at least one, has its whole
    sequence as its only shingle.
    """
    weights = mix(np.arange(1, n + 1, dtype=U64) * U64(0xD6E8FEB86659FD93)) | U64(1)
    total = len(hashes)
    if total >= n:
        grams = np.zeros(total - n + 1, dtype=U64)
        for i in range(n):
            grams += hashes[i : total - n + 1 + i] * weights[i]
        grams = mix(grams)
    else:
        grams = np.zeros(0, dtype=U64)
    sets = []
    bounds = first.tolist()
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= n:
            g = np.sort(grams[a : b - n + 1])
            keep = np.ones(len(g), dtype=bool)
            keep[1:] = g[1:] != g[:-1]
            sets.append(g[keep])
        elif b > a:
            sets.append(mix((hashes[a:b] * weights[: b - a]).sum(dtype=U64, keepdims=True) + U64(b - a)))
        else:
            sets.append(grams[:0])
    at = np.zeros(len(sets) + 1, dtype=np.int64)
    np.cumsum([len(s) for s in sets], out=at[1:])
    return (np.concatenate(sets) if sets else grams[:0]), at
