"""Words and shingles of whole Arrow batches as NumPy arrays: no Python loop over characters or words.

A chunk of documents is one byte array. Words are found from a mask of separators; a word's hash is a
difference of prefix sums of byte * BASE**position modulo 2**64, brought to position 0 by the inverse power,
then mixed. Chunks bound the memory; a document longer than a chunk is a chunk of its own, and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64

#: Space and U+0009 to U+000D separate words; only A-Z is lower-cased.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KEEP = np.arange(256, dtype=np.uint8)

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, kept for the next chunk."""
    global _powers
    if len(_powers[0]) < n:
        m = max(n, CHUNK_BYTES + 1)
        _powers = _geometric(_BASE, m), _geometric(_INVERSE, m)
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over all output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets (one more than documents) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `limit` bytes."""
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = to


@dataclass
class Words:
    """Words of a chunk: hash, byte range, and for each document its first word (one more than documents)."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(raw: np.ndarray, off: np.ndarray, case: np.ndarray = LOWER, separator: np.ndarray = SEPARATOR) -> Words:
    """raw: the chunk's bytes; off: its documents' offsets, from 0."""
    n = len(raw)
    inside = np.zeros(n + 1, bool)
    np.logical_not(separator[raw], out=inside[:n])
    start_mask = inside[:n].copy()
    start_mask[1:] &= ~inside[: n - 1]
    edges = off[1:-1]
    edges = edges[edges < n]
    start_mask[edges] = inside[edges]
    start = np.flatnonzero(start_mask)
    end_mask = inside[:n] & ~inside[1 : n + 1]
    edges = edges[edges > 0] - 1
    end_mask[edges] = inside[edges]
    end = np.flatnonzero(end_mask) + 1
    power, inverse = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((case[raw].astype(np.uint64) + _U(1)) * power[:n], out=total[1:])
    code = mix64((total[end] - total[start]) * inverse[start])
    return Words(code, start, end, np.searchsorted(start, off))


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside one document, and for each document its first one.

    Documents with fewer words have none.
    """
    counts = np.maximum(np.diff(w.first) - (n - 1), 0)
    first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=first[1:])
    at = np.arange(first[-1]) + np.repeat(w.first[:-1] - first[:-1], counts)
    return run_hash(w.hash, at, n), first


def run_hash(code: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position of `at` on; depends on their order and number."""
    out = np.full(len(at), n, np.uint64)
    for k in range(n):
        out = mix64(out * _U(_BASE) + code[at + k])
    return out
