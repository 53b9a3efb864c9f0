"""Benchmark decontamination by SimHash windows.

Every benchmark item is filed under windows of a size class that follows its own length
(at every offset), documents are cut into windows of the same classes at a stride of half
a window: an item that stands in a document covers one of those windows at some offset.
Windows of which less than half of the word pairs stand in any item are left out first.
Fingerprints of 64 bits are compared through four blocks of 16 bits: two that differ in
at most three bits agree on a whole block, so looking each block up finds all of them.
Each hit places the whole item in the document, and the weighted similarity of the word
shingles of item and place decides.  Items too short for that are looked up as whole
word sequences.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns
from .words import WordHasher, mix

WORD = re.compile(r"\w+")
SHINGLE = 5
BLOCKS, BLOCK_BITS, RADIUS = 4, 16, 3
SMALLEST, LARGEST = 6, 12288
CHUNK = 16_384
#: Word pairs of items are marked in a table of that many bits of index (4 MB).
PAIR_BITS = 22


def clean_run(n: int, similarity: float) -> int:
    """The exact run that an item of n words keeps at least in a place of the similarity.

    An edit more than 4 words from the ends takes 4 shingles or more of the item and puts as
    many others there; edits nearer to the ends take at most 4 words each.  All shingles
    count alike here: those of many items weigh less, and edits of them alone may be more.
    """
    edits = int(max(n - SHINGLE + 1, 0) * (1 - similarity) / (1 + similarity) / (SHINGLE - 1) + 1e-9)
    return -(-(n - 2 * (SHINGLE - 1) - edits) // (edits + 1))


def size_class(n: int, similarity: float = 0.8) -> int:
    """The window size of an item of n words: 6 times a power of two, so small that an edited copy holds a clean one.

    Window and half-window stride together fit in the item's clean run; only items of which
    that is under 8 words (as of the default similarity: under 16) have windows of 6 anyway.
    No class is over LARGEST, whose counts still fit in 16 bits.
    """
    room = clean_run(n, similarity)
    size = SMALLEST
    while 2 * size + size - 1 <= room and size < LARGEST:
        size *= 2
    return size


def features(words: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each pair of neighbouring words."""
    return mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])


def window_prints(feature: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of ``size`` words at ``starts``: each bit is the majority of its pairs' bits."""
    width = size - 1
    out = np.zeros(len(starts), np.uint64)
    step = max(1, (1 << 17) // width)
    for at in range(0, len(starts), step):
        own = feature[starts[at : at + step, None] + np.arange(width)]
        bits = np.unpackbits(own.astype("<u8").view(np.uint8).reshape(len(own), width, 8), axis=2, bitorder="little")
        ones = bits.sum(axis=1, dtype=np.int32) > width // 2
        out[at : at + step] = np.packbits(ones, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the five-word shingles by place; fewer words are one shingle."""
    n = min(SHINGLE, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k])
    return out


def sequences(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words by place."""
    out = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(out)])
    return out


def weighted_similarity(a: dict, b: dict, weight) -> float:
    """Sum of the smaller by the sum of the larger weighted counts."""
    both = sum(min(n, b[s]) * weight(s) for s, n in a.items() if s in b)
    every = sum(n * weight(s) for s, n in a.items()) + sum(n * weight(s) for s, n in b.items()) - both
    return both / every if every else 0.0


def counted(values: np.ndarray) -> dict[int, int]:
    keys, n = np.unique(values, return_counts=True)
    return dict(zip(keys.tolist(), n.tolist()))


class Items:
    """A block of benchmark items with their windows filed by block values."""

    def __init__(self, items: list[tuple[int, str]], min_words: int, similarity: float = 0.8):
        hasher = WordHasher()
        self.ids, self.words, self.counts = [], [], []
        self.short: dict[int, dict[int, list[int]]] = {}  # by number of words: the ids by hash
        prints: dict[int, list[tuple[np.ndarray, int]]] = {}
        pairs: list[np.ndarray] = []
        for key, text in items:
            words = hasher.hashes(WORD.findall((text or "").lower()))
            if len(words) < max(min_words, SMALLEST):
                if len(words):
                    self.short.setdefault(len(words), {}).setdefault(int(sequences(words, len(words))[0]), []).append(key)
                continue
            size = size_class(len(words), similarity)
            starts, own = np.arange(len(words) - size + 1), features(words)
            pairs.append(own)
            prints.setdefault(size, []).append((window_prints(own, starts, size), len(self.ids)))
            self.ids.append(key)
            self.words.append(len(words))
            self.counts.append(counted(shingles(words)))
        seen: dict[int, int] = {}
        for c in self.counts:
            for s in c:
                seen[s] = seen.get(s, 0) + 1
        self._seen, self._n = seen, len(self.ids)
        self._pairs = np.zeros(1 << PAIR_BITS, bool)
        for own in pairs:
            self._pairs[own >> np.uint64(64 - PAIR_BITS)] = True
        self.classes = {}
        for size, parts in sorted(prints.items()):
            values = np.concatenate([p for p, _ in parts])
            item = np.concatenate([np.full(len(p), i) for p, i in parts])
            offset = np.concatenate([np.arange(len(p)) for p, _ in parts])
            filed = []
            for b in range(BLOCKS):
                key = (values >> np.uint64(BLOCK_BITS * b)) & np.uint64(0xFFFF)
                order = np.argsort(key, kind="stable")
                filed.append((order, np.searchsorted(key[order], np.arange((1 << BLOCK_BITS) + 1, dtype=np.uint64))))
            self.classes[size] = (values, item, offset, filed)
        self._sorted = {n: np.sort(np.fromiter(held, np.uint64, len(held))) for n, held in self.short.items()}

    def exact(self, words: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, 1.0) of the first place of each short item that the words hold."""
        out = []
        for n, values in self._sorted.items():
            here = sequences(words, n)
            at = np.flatnonzero(values[np.minimum(np.searchsorted(values, here), len(values) - 1)] == here)
            found, first = np.unique(here[at], return_index=True)
            out += [(key, int(at[i]), n, 1.0) for h, i in zip(found.tolist(), first.tolist()) for key in self.short[n][h]]
        return out

    def may_match(self, feature: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """The windows half of whose pairs of words may stand in some item, as those of a copy do."""
        known = np.zeros(len(feature) + 1, np.int64)
        np.cumsum(self._pairs[feature >> np.uint64(64 - PAIR_BITS)], out=known[1:])
        return np.flatnonzero(2 * (known[starts + size - 1] - known[starts]) >= size - 1)

    def weight(self, shingle: int) -> float:
        """Shingles that fewer items have weigh more; those of no item weigh as those of one."""
        return 1 + float(np.log(self._n / max(1, self._seen.get(shingle, 1))))

    def within_radius(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (place in prints, filed window) whose fingerprints differ in at most RADIUS bits."""
        values, _, _, filed = self.classes[size]
        left, right = [], []
        for b, (order, edges) in enumerate(filed):
            key = ((prints >> np.uint64(BLOCK_BITS * b)) & np.uint64(0xFFFF)).astype(np.int64)
            low, n = edges[key], edges[key + 1] - edges[key]
            some = np.flatnonzero(n)
            n = n[some]
            where = np.repeat(some, n)
            filed_at = order[np.repeat(low[some] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            near = np.bitwise_count(prints[where] ^ values[filed_at]) <= RADIUS
            left.append(where[near])
            right.append(filed_at[near])
        return np.concatenate(left), np.concatenate(right)


class _Best:
    """The best place of each item that a document holds."""

    def __init__(self, words: np.ndarray, items: Items, similarity: float):
        self._words, self._items, self._similarity = words, items, similarity
        self._tried: set[tuple[int, int]] = set()
        self._found: dict[int, tuple[float, int]] = {}

    def verify(self, item: int, start: int) -> None:
        n = self._items.words[item]
        begin = max(0, min(start, len(self._words) - n))
        if (item, begin) in self._tried:
            return
        self._tried.add((item, begin))
        here = counted(shingles(self._words[begin : begin + n]))
        s = weighted_similarity(self._items.counts[item], here, self._items.weight)
        if s >= self._similarity and (s, -begin) > self._found.get(item, (0.0, 0)):
            self._found[item] = (s, -begin)

    def rows(self) -> list[tuple[int, int, int, float]]:
        return [(self._items.ids[i], -b, self._items.words[i], s) for i, (s, b) in sorted(self._found.items())]


def matches(texts: list[np.ndarray], items: Items, similarity: float) -> list[list[tuple[int, int, int, float]]]:
    """(item, first word, words, similarity) of the items that each text (word hashes) holds.

    Texts are laid end to end in chunks, so that their windows are fingerprinted together;
    no window crosses from one text to the next, a long text goes on in the next chunk.
    """
    best = [_Best(t, items, similarity) for t in texts]
    largest = max(items.classes, default=0)
    parts: list[tuple[int, int, np.ndarray]] = []
    held = 0
    for k, words in enumerate(texts):
        for at in range(0, max(len(words) - 1, 0), CHUNK):
            part = words[at : at + CHUNK + largest]
            parts.append((k, at, part))
            held += len(part)
            if held >= CHUNK:
                _search(parts, items, best)
                parts, held = [], 0
    if parts:
        _search(parts, items, best)
    return [b.rows() + items.exact(t) for b, t in zip(best, texts)]


def _search(parts: list[tuple[int, int, np.ndarray]], items: Items, best: list[_Best]) -> None:
    """Look up all windows of some stretches (text, place in it, words) and verify the hits."""
    text, at = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
    sizes = np.array([len(p[2]) for p in parts])
    begin = np.cumsum(sizes) - sizes
    feature = features(np.concatenate([p[2] for p in parts]))
    for size, (_, item, offset, _) in items.classes.items():
        stride = max(1, size // 2)
        counts = np.maximum((sizes - size) // stride + 1, 0) * (sizes >= size)
        owner = np.repeat(np.arange(len(parts)), counts)
        place = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)) * stride
        some = items.may_match(feature, begin[owner] + place, size)
        owner, place = owner[some], place[some]
        where, filed = items.within_radius(size, window_prints(feature, begin[owner] + place, size))
        own = owner[where]
        hits = zip(text[own].tolist(), item[filed].tolist(), (at[own] + place[where] - offset[filed]).tolist())
        for k, i, start in sorted(set(hits)):
            best[k].verify(i, start)


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_rows: int, block_bytes: int):
    """The benchmark in blocks of about ``block_rows`` rows or ``block_bytes`` bytes at most, each small enough to broadcast."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(-(-count // block_rows), -(-size // block_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield [(r["id"], r["text"]) for r in part.orderBy("id", "text").collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, min_words: int = 8, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_rows: int = 20_000, block_bytes: int = 8 << 20) -> DataFrame:
    """(id, item_id, first_word, n_words, similarity) of each item that a document holds.

    Words are runs of letters, digits and underscores, lower-cased.  Items under
    ``min_words`` words (6 at least) are found only as they are, word by word, at their
    first place; items without words match nothing; null and empty texts hold nothing;
    ids may be null; repeated rows are answered each; an empty benchmark gives no rows.
    The benchmark is taken in blocks of ``block_rows`` items and ``block_bytes`` bytes,
    each against all documents.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, item_id long, first_word long, n_words long, similarity double"
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = None
    for block in item_blocks(benchmark, item_id, item_text, block_rows, block_bytes):
        find = _finder(docs, block, min_words, similarity)

        def run(batches, find=find):
            search = find()
            for batch in batches:
                found = [(i, *m) for i, own in enumerate(search(batch["_text"].to_pylist())) for m in own]
                at, item, first, n, same = map(list, zip(*found)) if found else ([], [], [], [], [])
                yield {"_id": batch["_id"].take(pa.array(at, pa.int64())), "item_id": item, "first_word": first, "n_words": n, "similarity": same}

        part = map_columns(rows, run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = map_columns(rows.limit(0), lambda batches: iter(()), schema)
    return out.withColumnRenamed("_id", id_col)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, min_words: int = 8, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_rows: int = 20_000, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item of the benchmark; no shuffle."""
    for block in item_blocks(benchmark, item_id, item_text, block_rows, block_bytes):
        find = _finder(docs, block, min_words, similarity)

        def run(batches, find=find):
            search = find()
            for batch in batches:
                yield batch.filter(pa.array([not own for own in search(batch[text_col].to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def _finder(docs: DataFrame, block: list[tuple[int, str]], min_words: int, similarity: float):
    """Broadcasts a block of items; what is returned makes, on an executor, a search of texts."""
    shared = docs.sparkSession.sparkContext.broadcast(Items(block, min_words, similarity))

    def make():
        items, hasher = shared.value, WordHasher()

        def search(texts: list) -> list[list[tuple[int, int, int, float]]]:
            out = []
            for at in range(0, len(texts), 500):
                part = texts[at : at + 500]
                out += matches([hasher.hashes(WORD.findall((t or "").lower())) for t in part], items, similarity)
            return out

        return search

    return make
