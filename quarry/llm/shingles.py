"""Word shingles as sorted sets of 64-bit hashes, and MinHash signatures of them."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers, one for each place in a shingle, from a generator of fixed seed.
_PLACES = np.random.default_rng(20).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def words(text: str) -> list[bytes]:
    """Runs of anything but ASCII white space, with A-Z lower-cased."""
    return text.encode("utf-8", "replace").lower().split()


def shingle_set(text: str, k: int) -> np.ndarray:
    """The distinct k-word shingles' hashes, sorted; fewer words make one shingle, no words none."""
    w = words(text)
    n = len(w)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, n)
    if n < k:
        return _mixed((h * _PLACES[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out += h[i : n - k + 1 + i] * _PLACES[i]
    return np.unique(_mixed(out))


class MinHash:
    """Signatures of `size` 16-bit values, each from the least of its own permutation of the set."""

    STEP = 4096

    def __init__(self, size: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 1 << 32, (size, 1), dtype=np.uint32) | np.uint32(1)).astype(np.uint32)
        self.b = rng.integers(0, 1 << 32, (size, 1), dtype=np.uint32)
        self.room = np.empty((size, self.STEP), np.uint32)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        least = None
        for i in range(0, len(x), self.STEP):
            part = x[i : i + self.STEP]
            y = self.room[:, : len(part)]
            np.multiply(self.a, part, out=y)
            np.add(y, self.b, out=y)
            low = y.min(axis=1)
            least = low if least is None else np.minimum(least, low)
        return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2")
