"""Vectorised hashing of spans of a byte buffer: words, word shingles and chunks of many texts at once."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * _BASE)
_POWERS = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        n = max(n, SLICE + 4096)
        for k, factor in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, factor, U64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any span of 64-bit ``values`` follows."""
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * _powers(len(values) + 1)[0][:len(values)], out=sums[1:])
    return sums


def from_sums(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    down = _powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, wherever it stands: a polynomial from prefix sums."""
    return from_sums(prefix_sums(_BYTE[raw]), starts, ends)


def word_spans(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes other than ASCII white space."""
    solid = ~WHITE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offs] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(offs, first, side="right") - 1


def shingles(words: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``n`` words within a row, and their rows."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, U64), np.zeros(0, row.dtype)
    acc = words[:count].copy()
    for k in range(1, n):
        acc *= _BASE
        acc += words[k:count + k]
    whole = row[:count] == row[n - 1:]
    return mix(acc[whole] + U64(n)), row[:count][whole]


def row_sets(raw: np.ndarray, offs: np.ndarray, n: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its ``n``-word shingles, A-Z lower-cased.

    A row with fewer words has its whole sequence as one shingle; one without words has none.
    """
    raw = LOWER[raw]
    first, last, row = word_spans(raw, offs)
    words = span_hashes(raw, first, last)
    found, of = shingles(words, row, n)
    rows = len(offs) - 1
    cut = np.searchsorted(of, np.arange(rows + 1))
    start = np.searchsorted(row, np.arange(rows + 1))
    out = []
    for k in range(rows):
        if cut[k + 1] > cut[k]:
            got = np.sort(found[cut[k]:cut[k + 1]])
            out.append(got[np.concatenate(([True], got[1:] != got[:-1]))])
        elif start[k + 1] > start[k]:
            short = words[start[k]:start[k + 1]]
            out.append(shingles(short, np.zeros(len(short), int), len(short))[0])
        else:
            out.append(np.zeros(0, U64))
    return out
