"""Exact duplicates: Patricia tries of full byte strings, dealt out by length and content hash.

Every text's bytes are inserted into the compressed trie of its length and hash, whose
terminal nodes hold the smallest row that brought the text; a hash alone never decides.  Tries are built three
times: in each task over a window of its rows, over a salted share of the windows' texts,
and over what the shares have left, so that a text which a third of all rows hold reaches
no task more often than there are windows in a share.  Texts whose length and hash no
other row has stay where they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmaps import fitted, held
from .common import discard, map_columns, materialize
from .radix import Node, common, insert

#: Bytes of texts that the tries of one window hold before they are let go.
WINDOW = 64 << 20
#: Shares of the windows that meet first.
SALTS = 16
ROW_BITS = 33


def normalised(batch, column: str) -> list[bytes]:
    """The UTF-8 bytes of each text with A-Z lower-cased; null counts as empty."""
    return [b"" if t is None else t.lower() for t in batch[column].cast(pa.binary()).to_pylist()]


def content_key(text: bytes, hash_bits: int) -> int:
    """A signed 64-bit number of the text's length and ``hash_bits`` bits of its hash."""
    found = xxhash.xxh3_64_intdigest(text, seed=7) >> (64 - hash_bits) if hash_bits else 0
    return xxhash.xxh3_64_intdigest(b"%d %d" % (len(text), found)) - (1 << 63)


def _keys(docs: DataFrame, text_col: str, hash_bits: int) -> DataFrame:
    """(key, n): how often a window has each key; windows are batches."""

    def run(batches):
        for batch in batches:
            keys, n = np.unique(np.array([content_key(t, hash_bits) for t in normalised(batch, text_col)], np.int64), return_counts=True)
            yield {"key": keys, "n": n}

    return map_columns(docs.select(text_col), run, "key long, n long")


class _Windows:
    """Tries by length and hash; what is let go at once is bounded by the bytes it holds."""

    def __init__(self):
        self.tries: dict[int, Node] = {}
        self.bytes = 0

    def first(self, key: int, text: bytes, row: int) -> int:
        """The row that brought the text to this window, which is ``row`` if it is new."""
        if self.bytes > WINDOW:
            self.tries, self.bytes = {}, 0
        root = self.tries.get(key)
        if root is None:
            root = self.tries[key] = Node(b"")
        node = insert(root, text)
        if node.value is None:
            node.value = row
            self.bytes += len(text) + 200
        return node.value


class _Subtree:
    """The trie of one length and hash, whose keys come in order: what lies left of the newest is done and goes.

    That is the spill by subtree: the order is that of Spark's sort, which spills to disk,
    and of the trie only the newest key's path is kept.
    """

    def __init__(self):
        self.key, self.root = None, None

    def add(self, key, text: bytes) -> Node:
        """The terminal node of ``text``; its value is None if the text is new."""
        if key != self.key:
            self.key, self.root = key, Node(b"")
        node, at = self.root, 0
        while node.children:
            child = next(iter(node.children.values()))  # the only one
            if text.startswith(child.label, at):
                at += len(child.label)
                node = child
                continue
            # A subtree that the new text doesn't enter gets no further keys.
            shared = common(child.label, text, at)
            node.children.clear()
            if shared:
                upper = node.children[text[at]] = Node(child.label[:shared])
                node, at = upper, at + shared
            break
        return insert(node, text[at:])


def _merge(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(row, key, head, text): the smallest row of equal text among those of equal ``keys``; the text at that row alone."""

    def run(batches):
        tries = _Subtree()
        for batch in batches:
            heads, kept = [], []
            for key, salt, text, row in zip(*(batch[c].to_pylist() for c in ("key", "salt", "text", "row"))):
                node = tries.add((key, salt), text)
                kept.append(text if node.value is None else None)
                if node.value is None:
                    node.value = row
                heads.append(node.value)
            yield {"row": batch["row"], "key": batch["key"], "head": heads, "text": kept}

    rows = texts.repartition(*keys).sortWithinPartitions("key", "salt", "text", "row")
    return map_columns(rows, run, "row long, key long, head long, text binary")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: str = "largest", hash_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept and text_sha256.

    Texts are equal when they are the same bytes after A-Z are lower-cased; a null text
    counts as empty.  Of equal texts the row of the ``largest`` (or ``smallest``) id owns
    the text: ``keep_id`` is its id and ``kept`` is true for it alone, also where several
    rows have that id.  A null id owns a text only if no row of it has another; then
    keep_id is null.  ``group_size`` counts rows, repeated ones too.  Empty texts are one
    group; an empty table gives no rows; further columns are ignored.  ``hash_bits`` under
    64 makes different texts share tries, which changes no result.
    """
    if owner not in ("largest", "smallest"):
        raise ValueError(f"owner must be largest or smallest, not {owner}")
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    shared = materialize(_keys(docs, "_text", hash_bits).groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"), "exact-keys")
    bits = spark.sparkContext.broadcast(fitted(shared))
    discard(shared)

    def rows(batches):
        at = TaskContext.get().partitionId() << ROW_BITS
        windows = _Windows()
        for batch in batches:
            texts = normalised(batch, "_text")
            keys = np.array([content_key(t, hash_bits) for t in texts], np.int64)
            met = held(bits.value, keys)
            own = range(at, at + len(texts))
            firsts = [windows.first(k, t, r) if m else None for k, t, r, m in zip(keys.tolist(), texts, own, met)]
            at += len(texts)
            yield {
                "_id": batch["_id"],
                "row": own,
                "first": firsts,
                "text_sha256": [hashlib.sha256(t).hexdigest() for t in texts],
                "key": keys,
                "text": [t if f == r else None for t, f, r in zip(texts, firsts, own)],
            }

    seen = materialize(map_columns(docs, rows, f"_id {kind}, row long, first long, text_sha256 string, key long, text binary"), "exact-rows")
    carried = seen.where("text is not null").select("row", "key", "text", F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"))
    shares = materialize(_merge(carried, ["key", "salt"]), "exact-shares")
    rest = shares.where("text is not null").select("row", "key", "text", F.lit(0).cast("long").alias("salt"))
    roots = materialize(_merge(rest, ["key"]).select(F.col("row").alias("head"), F.col("head").alias("root")), "exact-roots")
    roots = shares.select(F.col("row").alias("first"), "head").join(roots, "head").select("first", "root")

    # An owner is chosen by aggregation with partial sums, so that no text's rows gather in one task.
    grouped = seen.where("first is not null").select("_id", "row", "first", "text_sha256")
    some, at = (F.col("_id").isNotNull(), -F.col("row")) if owner == "largest" else (F.col("_id").isNull(), F.col("row"))
    best = F.max if owner == "largest" else F.min
    owners = grouped.join(roots, "first").groupBy("root").agg(best(F.struct(some.alias("some"), "_id", at.alias("at"))).alias("owner"), F.count("*").alias("group_size"))
    owners = materialize(roots.join(owners, "root").select("first", F.col("owner._id").alias("keep_id"), F.abs("owner.at").alias("at"), "group_size"), "exact-owners")
    out = grouped.join(owners, "first").select("_id", "keep_id", "group_size", (F.col("at") == F.col("row")).alias("kept"), "text_sha256")
    alone = seen.where("first is null").select("_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return out.unionByName(alone).withColumnRenamed("_id", id_col)
