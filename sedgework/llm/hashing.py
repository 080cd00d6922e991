"""Vectorised word and shingle hashes over batches of texts, with numpy.

A batch's UTF-8 bytes are hashed as a whole: each byte is looked up in a table of random 64-bit
numbers, prefix sums of these times powers of an odd base give every word's hash in one step, and a
final mix spreads them.  All arithmetic is modulo 2**64.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = int(_rng.integers(1, 2**61)) * 8 + 5
_INVERSE = pow(_BASE, -1, 2**64)
_GRAM = U(int(_rng.integers(1, 2**61)) * 8 + 3)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = [np.ones(1, U), np.ones(1, U)]
#: Bytes of text hashed in one go; only a single longer text takes more.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, U(base))
            p[0] = U(1)
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words of each text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return np.empty(0, U), np.zeros(len(texts), np.int64)
    space = _SPACE[data]
    edges = np.cumsum(sizes)
    first = np.zeros(len(data) + 1, bool)  # a text begins here
    first[edges] = True
    first[0] = True
    inside = ~space
    starts = inside.copy()
    starts[1:] &= space[:-1] | first[1:-1]
    ends = inside
    ends[:-1] &= space[1:] | first[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends)
    up, down = _power(len(data))
    sums = _TABLE[_LOWER[data] if lower else data]
    sums *= up[: len(data)]
    np.cumsum(sums, out=sums)
    h = sums[e]
    h[s > 0] -= sums[s[s > 0] - 1]
    h = mix(h * down[s] + (e - s).astype(U))
    counts = np.searchsorted(s, edges)
    return h, np.diff(counts, prepend=0)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, for each place that k words follow (also across texts)."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, U)
    for j in range(k):
        out *= _GRAM
        out += h[j : j + n]
    return mix(out)


def window_min(x: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Least value of each w consecutive ones and the place of its first occurrence."""
    at = np.arange(len(x), dtype=np.int64)
    done = 1
    while done < w:
        step = min(done, w - done)
        n = max(0, len(x) - step)
        less = x[step : step + n] < x[:n]
        x, at = np.where(less, x[step : step + n], x[:n]), np.where(less, at[step : step + n], at[:n])
        done += step
    return x, at
