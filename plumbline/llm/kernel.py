"""Numpy helpers for Arrow batches of text: word boundaries and 64-bit word hashes.

All functions take a bounded piece of text at a time. Hashes are polynomials modulo 2**64 over
random byte codes, followed by a bit mixer, so equal words always get equal hashes in any task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.default_rng(20240131)
_CODE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = [int(x) * 2 + 1 for x in _rng.integers(2**61, 2**62, 4)]
_INV = [pow(b, -1, 2**64) for b in _BASE]
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PIECE = 1 << 18
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit word."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of a fixed odd number and of its inverse."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, _PIECE + 1)
        out = []
        for b in (_BASE[which], _INV[which]):
            p = np.full(size, b, U64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U64))
        have = _powers[which] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and the offsets of each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def pieces(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [i, j) whose texts have about ``most`` bytes together, with their bytes and offsets."""
    if len(column) == 0:
        return
    buf, offs = text_buffers(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + most, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each row the index of its first word (one more at the end)."""
    inside = ~_GAP[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offs[:-1] < offs[1:]
    a, b = offs[:-1][full], offs[1:][full] - 1
    first[a] = inside[a]
    last[b] = inside[b]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte span; the spans are in order and don't overlap."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + _PIECE, "right")))
        s, e = starts[i:j] - lo, ends[i:j] - lo
        part = buf[lo : lo + e[-1]]
        codes = _CODE[_LOWER[part] if lower else part]
        pw, inv = powers(len(part) + 1, 0)
        total = np.zeros(len(part) + 1, U64)
        np.cumsum(codes * pw[:-1], out=total[1:])
        out[i:j] = (total[e] - total[s]) * inv[s] + (e - s).astype(U64)
        i = j
    return mix(out)


def sequence_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 1) -> np.ndarray:
    """A hash of each run h[start:end] of word hashes, by prefix sums."""
    pw, inv = powers(len(h) + 1, which)
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(h * pw[: len(h)], out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(U64))


def grams(h: np.ndarray, first: np.ndarray, k: int, which: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words within a row, their start words, and the first run of each row."""
    n = len(h)
    counts = np.diff(first)
    per_row = np.maximum(counts - (k - 1), 0)
    row_first = np.zeros(len(per_row) + 1, np.int64)
    np.cumsum(per_row, out=row_first[1:])
    if n < k or not row_first[-1]:
        return np.zeros(0, U64), np.zeros(0, np.int64), row_first
    start = np.arange(row_first[-1]) + np.repeat(first[:-1] - row_first[:-1], per_row)
    return sequence_hashes(h, start, start + k, which), start, row_first


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return x.view(U64)
