"""Hashed word shingles of whole texts with numpy: words are hashed from byte prefix sums, shingles from words."""

from __future__ import annotations

import numpy as np

from folioscope.llm.common import splitmix

_r = np.random.RandomState(20250)
#: A random odd number for each byte; A to Z count as a to z.
_TABLE = (_r.randint(0, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_TABLE[65:91] = _TABLE[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = {"n": 0}


def _up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and its inverse, kept for the longest text so far."""
    if _powers["n"] < n:
        n = max(1 << 16, 1 << int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
        _powers["n"] = n
    return _powers["up"], _powers["down"]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word [^\\x20\\x09-\\x0D]+, in order."""
    b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    space = np.ones(len(b) + 2, np.int8)
    space[1:-1] = _SPACE[b]
    edges = np.flatnonzero(np.diff(space))
    start, end = edges[::2], edges[1::2]
    up, down = _up_to(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_TABLE[b] * up[: len(b)], out=sums[1:])
    return splitmix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_set(text: str, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text of fewer words has its whole sequence as the only one, one without words none."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(size, len(w))
    total = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        total = splitmix(total + w[j : len(w) - k + 1 + j])
    return np.unique(total)
