"""Document fingerprints from prefix polynomial hashes.

A text's prefix hashes, modulo a prime, give the hash of every span by two look-ups, so
equal spans are found at once and the longest common extension of two places by binary
search.  The fingerprint of a text is its whole hash and, for each of ``BINS`` classes of
span hashes, a byte of the smallest one: equal texts have equal fingerprints, and the
share of equal bytes estimates the likeness of the two sets of spans.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_name, map_columns, materialize

PRIME = np.uint64((1 << 31) - 1)
BASES = (1_000_003, 998_244_353)
SPAN = 16
BINS = 128
BIN_BITS = np.uint64(57)
SHIFT = np.uint64(31)


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1, for x below 2^62."""
    x = (x & PRIME) + (x >> SHIFT)
    x = (x & PRIME) + (x >> SHIFT)
    return np.where(x >= PRIME, x - PRIME * (x >= PRIME), x)


class _Powers:
    """The powers of a base and of its inverse, as far as they were needed."""

    def __init__(self, base: int):
        p = int(PRIME)
        self._steps = base % p, pow(base, p - 2, p)
        self._tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        for k, step in enumerate(self._steps):
            t = self._tables[k]
            while len(t) < n:
                t = np.concatenate([t, _mod(t * np.uint64(pow(step, len(t), int(PRIME))))])
            self._tables[k] = t
        return self._tables[0][:n], self._tables[1][:n]


_powers = [_Powers(b) for b in BASES]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class PrefixHash:
    """Prefix hashes of a sequence of numbers below 2^31, under two bases."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        values = symbols.astype(np.uint64) + np.uint64(1)
        self._prefix = []
        for table in _powers:
            power, _ = table.get(self.n + 1)
            out = np.zeros(self.n + 1, np.uint64)
            np.cumsum(_mod(values * power[: self.n]), out=out[1:])
            self._prefix.append(_mod(out))

    def spans(self, length: int) -> np.ndarray:
        """The 62-bit hashes of all spans of a length, by start."""
        return self.hash(np.arange(self.n - length + 1), length) if length <= self.n else np.zeros(0, np.uint64)

    def hash(self, start, length: int):
        """The hash of the span from ``start`` (a number or an array)."""
        start = np.asarray(start)
        out = np.zeros(start.shape, np.uint64)
        for table, prefix in zip(_powers, self._prefix):
            _, inverse = table.get(self.n + 1)
            h = _mod((prefix[start + length] + PRIME - prefix[start]) * inverse[start])
            out = (out << SHIFT) | h
        return out

    def equal(self, start: int, other: PrefixHash, at: int, length: int) -> bool:
        return bool(self.hash(start, length) == other.hash(at, length))

    def common(self, start: int, other: PrefixHash, at: int) -> int:
        """The longest common extension to the right of ``start`` here and ``at`` there."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(start, other, at, middle):
                low = middle
            else:
                high = middle - 1
        return low


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_EDGES = np.arange(BINS, dtype=np.uint64) << BIN_BITS


def fingerprint(hashes: PrefixHash) -> str:
    """Whole hash, length and the bytes of the bins (``--`` where no span falls) as hexadecimal digits."""
    spans = hashes.spans(min(SPAN, hashes.n)) if hashes.n else np.zeros(0, np.uint64)
    mixed = np.sort(_mix(spans))
    at = np.searchsorted(mixed, _EDGES)
    held = np.append(at[1:], len(mixed)) > at
    low = (mixed[np.minimum(at, max(len(mixed) - 1, 0))] & np.uint64(255)).astype(np.uint8) if len(mixed) else np.zeros(BINS, np.uint8)
    cells = low.tobytes().hex()
    if not held.all():
        cells = "".join(cells[2 * i : 2 * i + 2] if held[i] else "--" for i in range(BINS))
    return f"{int(hashes.hash(0, hashes.n)):016x}{hashes.n:08x}{cells}"


def likeness(a: str, b: str) -> float:
    """The estimated share of spans that two texts have in common, from 0 to 1."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(f[24:].encode(), "S2") for f in (a, b))
    some = (x != b"--") | (y != b"--")
    n = int(some.sum())
    if not n:
        return 0.0
    share = int(((x == y) & some).sum()) / n
    return max(0.0, (share - 1 / 256) / (1 - 1 / 256))


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, kept_prefix long"
NAMES = [c.split()[0] for c in RESULT.split(", ")]


def _answer(text: str, hashes: PrefixHash, own: str, after: str, after_own: str) -> tuple:
    n = len(text)
    quarter = n // 4
    edited = text[: n - quarter] + after[:quarter]
    if edited == text:
        changed, other = hashes, own
    else:
        changed = PrefixHash(code_points(edited))
        other = fingerprint(changed)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return n, digest, own, other, likeness(own, other), likeness(own, after_own), hashes.common(0, changed, 0)


#: Rows of a walked range: answered ones, its last text, its first text.
ANSWER, LAST, FIRST = 0, 1, 2


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and its likeness to both.

    The edited text of a document replaces its last quarter by the first code points of
    the document with the next id (after the last: the first).  Rows are dealt out by
    ranges of ids and each task walks its range in order; the last text of each range is
    joined with the first one of the next, by the ranges' numbers.

    A null text counts as empty, and two empty texts are alike (1.0); a single row is
    its own neighbour; null ids come first; rows of one id follow each other by the hash
    of their texts, so that many of them are several ranges; an empty table gives no
    rows.  ``kept_prefix`` is the longest common prefix of a text and its edited text.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def walk(batches):
        range_ = TaskContext.get().partitionId()
        last = None  # (its id as an array of one, text, hashes, fingerprint)
        for batch in batches:
            ids, out, places = batch["_id"], [], []
            held = last
            for i, text in enumerate(batch["_text"].to_pylist()):
                text = text or ""
                hashes = PrefixHash(code_points(text))
                own = fingerprint(hashes)
                if last is None:
                    out.append((FIRST, range_, text) + (None,) * len(NAMES))
                    places.append(1)
                else:
                    out.append((ANSWER, range_, None) + _answer(*last[1:], text, own))
                    places.append(i)
                last = (i, text, hashes, own)
            # The row before the batch's own ones is the last one of the batch before.
            before = held[0] if held else ids.slice(0, 0)
            every = pa.concat_arrays([before if len(before) else pa.nulls(1, ids.type), ids])
            yield {"_id": every.take(pa.array(places, pa.int64()))} | by_name(out, ["kind", "range", "text", *NAMES])
            if last is not None and len(ids):
                last = (ids.slice(len(ids) - 1), *last[1:])
        if last is not None:
            yield {"_id": last[0]} | by_name([(LAST, range_, last[1]) + (None,) * len(NAMES)], ["kind", "range", "text", *NAMES])

    def link(batches):
        for batch in batches:
            out = []
            for text, after in zip(batch["text"].to_pylist(), batch["after"].to_pylist()):
                both = [PrefixHash(code_points(t)) for t in (text, after)]
                own, next_ = map(fingerprint, both)
                out.append(_answer(text, both[0], own, after, next_))
            yield {"_id": batch["_id"]} | by_name(out, NAMES)

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    order = ["_id", F.xxhash64("_text"), "_text"]
    rows = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    walked = materialize(map_columns(rows, walk, f"_id {kind}, kind int, range int, text string, {RESULT}"), "fingerprints")
    firsts = walked.where(F.col("kind") == FIRST).select("range", F.col("text").alias("after"))
    held = sorted(r["range"] for r in firsts.select("range").collect())  # a number for each task
    follows = walked.sparkSession.createDataFrame([(r, held[(i + 1) % len(held)]) for i, r in enumerate(held)], "range int, next int")
    ends = walked.where(F.col("kind") == LAST).select("_id", "range", "text").join(follows, "range")
    ends = ends.join(firsts.withColumnRenamed("range", "next"), "next").select("_id", "text", "after")
    out = walked.where(F.col("kind") == ANSWER).select("_id", *NAMES).unionByName(map_columns(ends, link, f"_id {kind}, {RESULT}"))
    return out.withColumnRenamed("_id", id_col)
