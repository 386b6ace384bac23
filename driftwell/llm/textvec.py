"""Word and shingle hashes of whole texts as numpy vectors.

Words are maximal runs of bytes other than space and \\x09-\\x0D, with A-Z lower-cased. A word's
hash is a polynomial over random 64-bit values of its bytes, read off prefix sums, so that the
cost is a few vector operations per text whatever the number of words.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[32, *range(9, 14)]] = False
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = int(_rng.integers(1, 2**60)) * 8 + 5
_STEP = _U(0x9E3779B97F4A7C15)
_power = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power[0]) < n:
        size = max(n, 2 * len(_power[0]), 1 << 14)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(size, _U(base), dtype=np.uint64)
            steps[0] = 1
            _power[i] = np.multiply.accumulate(steps)
    return _power[0], _power[1]


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and the start and end of each word."""
    data = _LOWER[np.frombuffer(raw, dtype=np.uint8)]
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _IS_WORD[data]
    edges = np.flatnonzero(np.diff(inside))
    return data, edges[::2], edges[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    forward, backward = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * forward[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * backward[starts])


def word_hashes(text: str) -> np.ndarray:
    return span_hashes(*word_spans(text.encode("utf-8", "surrogatepass")))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of ``width``-word shingles; of a shorter text, its whole sequence as one."""
    words = word_hashes(text) if text else np.zeros(0, dtype=np.uint64)
    if not len(words):
        return words
    k = min(width, len(words))
    count = len(words) - k + 1
    total = np.full(count, k, dtype=np.uint64)
    for i in range(k):
        total = mix(total * _STEP + words[i : i + count])
    return np.unique(total)
