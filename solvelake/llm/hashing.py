"""Vectorised hashing of words and bytes inside tasks: whole Arrow columns of text at a time, in bounded pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
CHUNK = 1 << 18

_rng = np.random.default_rng(20240229)
#: A random number for each byte.
BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
#: Bytes with A-Z taken as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The first so many of eight bytes.
_HEADS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(_BASE, CHUNK + 1), _powers(_INVERSE, CHUNK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_pieces(column: pa.Array, limit: int = 1 << 22) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets from 0, bytes) of runs of rows of about ``limit`` bytes at most; null texts are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, at[row : end + 1] - at[row], raw[at[row] : at[end]]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without white space), and the first word of each document, with the end."""
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = inside[edges]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes (``lower``: with A-Z as a-z), the same wherever the span stands.

    Eight bytes after eight are mixed into what came before, so no two spans of up to eight bytes share a hash, and
    longer ones only as random numbers do.
    """
    padded = np.concatenate([LOWER[data] if lower else data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = ends - starts
    out = mix(size.astype(U))
    open_, at = np.flatnonzero(size), 0
    while len(open_):
        left = size[open_] - at
        out[open_] = mix(out[open_] ^ (eight[starts[open_] + at] & _HEADS[np.minimum(left, 8)]))
        open_, at = open_[left > 8], at + 8
    return out


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each ``size`` consecutive hashes; empty if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    out = hashes[:n].copy()
    for k in range(1, size):
        out *= U(0xD6E8FEB86659FD93)
        out += hashes[k : k + n]
    return mix(out + U(size))
