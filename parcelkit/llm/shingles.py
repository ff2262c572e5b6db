"""Sets of distinct five-word shingles as sorted 64-bit numbers, and their minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .words import mix, of_column

WORDS = 5
_FACTOR = np.uint64(0xD6E8FEB86659FD93)


def _combined(words: np.ndarray, width: int) -> np.ndarray:
    """A number for each run of ``width`` words."""
    n = len(words) - width + 1
    out = np.full(max(n, 0), np.uint64(width), np.uint64)
    for k in range(width):
        out = out * _FACTOR + words[k : k + n]
    return mix(out)


def sets_of(column: pa.Array, width: int = WORDS) -> Iterator[np.ndarray]:
    """Each row's set. A text of fewer words is one shingle; a text without words has none.

    Two different shingles of a pair of texts share a number with a chance of about n * n / 2 ** 64.
    """
    words, at = of_column(column)
    runs = _combined(words, width)
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        if hi - lo >= width:
            yield np.unique(runs[lo : hi - width + 1])
        else:
            yield _combined(words[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64)


class Minima:
    """Minima of ``n`` hash functions (multiply-add on 64 bits, the high 32 kept)."""

    def __init__(self, n: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 2**64, n, dtype=np.uint64)

    def of(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), 2**32 - 1, np.uint64)
        for lo in range(0, len(shingles), 512):  # the block of products stays in the cache
            block = (shingles[None, lo : lo + 512] * self.a[:, None] + self.b[:, None]) >> np.uint64(32)
            np.minimum(out, block.min(axis=1), out=out)
        return out
