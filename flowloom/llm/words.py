"""Word hashes by numpy, the same in every process."""

from __future__ import annotations

import numpy as np
import xxhash


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (wraps around by design)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Known(dict):
    def __missing__(self, word):
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class WordHasher:
    """64-bit hashes of words (text or bytes); those that were met are kept, up to ``keep`` of them."""

    def __init__(self, keep: int = 400_000):
        self._known, self._keep = _Known(), keep

    def hashes(self, words: list) -> np.ndarray:
        if len(self._known) > self._keep:
            self._known.clear()
        return np.fromiter(map(self._known.__getitem__, words), np.uint64, len(words))
