"""Vector work on the bytes of many texts at once, for use inside tasks.

Hashes are polynomials over the bytes, modulo 2**64, from prefix sums, then mixed; so any span's
hash takes constant time.  Bytes go through a table of random 64-bit values first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of x over all bits (in place where possible)."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0xA0761D6478BD642F)
    x ^= x >> U(32)
    return x


class Prefix:
    """Prefix sums of a text buffer; span(s, e) hashes buffer[s:e]."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, buf: np.ndarray, fold: bool = False, seed: int = 1):
        table = np.random.RandomState(seed).randint(0, 2**63 - 1, 256).astype(U) * U(2) + U(1)
        base = 0x9E3779B97F4A7C15 + 2 * seed * 0x1000193 | 1
        n = len(buf) + 1
        up, down = self._powers.get(seed, (np.zeros(0, U), np.zeros(0, U)))
        if len(up) < n:
            size = max(n, SLICE)
            up, down = np.full(size, base % 2**64, U), np.full(size, pow(base, -1, 2**64), U)
            up[0] = down[0] = 1
            up, down = np.cumprod(up), np.cumprod(down)
            self._powers[seed] = (up, down)
        self.down = down
        val = (table[_FOLD] if fold else table)[buf]
        val *= up[: n - 1]
        self.sums = np.zeros(n, U)
        np.cumsum(val, out=self.sums[1:])

    def span(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        h = self.sums[e] - self.sums[s]
        h *= self.down[s]
        h += (e - s).astype(U) * U(0x632BE59BD9B4E019)
        return mix(h)

    def every(self, k: int) -> np.ndarray:
        """Hashes of the k bytes that start at each place."""
        h = self.sums[k:] - self.sums[:-k]
        h *= self.down[: len(h)]
        return mix(h)


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of pieces of about SLICE bytes; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        row = 0
        for chunk in column.chunks:
            for lo, hi, buf, offs in slices(chunk):
                yield lo + row, hi + row, buf, offs
            row += len(chunk)
        return
    if not len(column):
        return
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    offs = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + SLICE, "right")) - 1)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space) and the number before each text."""
    body = ~_SPACE[buf]
    first, last = body.copy(), body.copy()
    first[1:] &= ~body[:-1]
    last[:-1] &= ~body[1:]
    full = offs[1:] > offs[:-1]
    a, z = offs[:-1][full], offs[1:][full] - 1
    first[a], last[z] = body[a], body[z]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, offs)


def packed(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(x).tobytes() for x in arrays]


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Which of `parts` equal key ranges each key falls into; rises with the key."""
    return ((keys >> U(40)) * U(parts) >> U(24)).astype(np.int64)


def cut_points(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: the key ranges that have any, and the slice bounds."""
    p = part_of(keys, parts)
    at = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else np.zeros(0, np.int64)
    return p[at], np.r_[at, len(keys)]


def counts_of(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of their weights."""
    if weights is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(weights, at) if len(at) else weights[:0]
