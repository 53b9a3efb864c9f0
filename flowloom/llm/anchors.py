"""Content-chosen positions of byte strings and span hashes by prefix sums.

Every window of ``window`` bytes has one anchor: the start of its q-gram of the smallest
hash (the leftmost of equal ones).  The choice depends on the window's bytes alone, so
equal windows have their anchors at the same place.
"""

from __future__ import annotations

import numpy as np

from .words import mix

PIECE = 1 << 17
INDEX_BITS = np.uint64(18)
INDEX = np.uint64((1 << 18) - 1)
BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20)
_SYMBOLS = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as far as they were needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = _powers(BASE, 2 * n), _powers(pow(BASE, -1, 1 << 64), 2 * n)


_held = Powers()


class Prefix:
    """Hashes of the spans of a byte string."""

    def __init__(self, data: bytes | np.ndarray):
        codes = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
        _held.reach(len(codes) + 1)
        self._sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_SYMBOLS[codes] * _held.up[: len(codes)], out=self._sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * _held.down[start] + (end - start).astype(np.uint64))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values, by block-wise running minima from both sides."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(prefix: Prefix, n: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, anchor, gram hash): windows that start at low..high have this anchor; ascending."""
    parts = []
    for at in range(0, max(0, n - window + 1), PIECE):
        end = min(at + PIECE, n - window + 1)  # window starts at..end-1
        start = np.arange(at, end + window - gram)
        hashes = prefix.spans(start, start + gram)
        local = np.arange(len(start), dtype=np.uint64)
        least = sliding_least((hashes & ~INDEX) | local, window - gram + 1) & INDEX
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        place = least[first].astype(np.int64)
        last = np.append(first[1:], len(least)) - 1
        parts.append((at + first, at + last, at + place, hashes[place]))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def chosen(hashes: np.ndarray, width: int) -> np.ndarray:
    """The places that are the least (leftmost of equal ones) of some ``width`` neighbours; of fewer values the least."""
    n = len(hashes)
    if n <= width:
        return np.argmin(hashes, keepdims=True) if n else np.zeros(0, np.int64)
    parts = []
    for at in range(0, n - width + 1, PIECE):
        piece = hashes[at : at + PIECE + width - 1]
        local = np.arange(len(piece), dtype=np.uint64)
        least = sliding_least((piece & ~INDEX) | local, width) & INDEX
        parts.append(at + least[np.concatenate([[True], least[1:] != least[:-1]])].astype(np.int64))
    return np.unique(np.concatenate(parts))
