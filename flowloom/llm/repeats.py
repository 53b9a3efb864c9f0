"""Exact removal of repeated byte strings by refined q-gram buckets.

A position is repeated if the ``length`` bytes from it also stand elsewhere.  As in
bucket-pointer refinement of a suffix array, positions start in the bucket of a q-gram and
buckets are split by identifiers of later offsets until only equal strings share one;
what a refinement settles is reused and never refined again.  Two things make it a
distributed job.  The initial bucket of a position is that of the q-gram that the bytes
choose themselves (its anchor), so neighbouring positions share a bucket and a
displacement, and one row stands for a run of them.  Identifiers are hashes of whole
offset ranges, so that runs are refined, not positions:

1. a run whose q-gram stands nowhere else holds no repeated position;
2. a run whose whole reach (all its strings) stands elsewhere is repeated throughout;
3. the others, which an edit or a border cuts, are split into blocks of ``BLOCK``
   positions and judged in the same two ways (common core, whole reach);
4. blocks that are still open are judged position by position.

Runs that were settled in step 2 take part in 3 and 4 as one representative of each
bucket, since open runs may repeat them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Prefix, anchors
from .bitmaps import bitmap, held as may_hold
from .common import by_name, discard, map_columns, materialize
from .words import mix

GRAM = 128
BLOCK = 16
ID = ["doc", "key"]


def _bytes(text) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc, key, low, high, at, gram, reach): runs of positions with one anchor, by text."""
    names = ["doc", "key", "low", "high", "at", "gram", "reach"]

    def run(batches):
        for batch in batches:
            parts = []
            for doc, key, text in zip(batch["doc"], batch["key"], batch["text"]):
                data = _bytes(text)
                if len(data) < length:
                    continue
                prefix = Prefix(data)
                low, high, at, grams = anchors(prefix, len(data), length, gram)
                reach = prefix.spans(low, high + length) ^ mix((at - low).astype(np.uint64))
                parts.append((np.full(len(low), doc), np.full(len(low), key), low, high, at, grams.view(np.int64), reach.view(np.int64)))
            yield pd.DataFrame({n: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i, n in enumerate(names)})

    return docs.mapInPandas(run, ", ".join(f"{n} long" for n in names))


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, with_kept: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row, and with ``with_kept`` the bytes.

    Each byte covered by a string of ``length`` bytes that also starts anywhere else goes;
    strings are judged on the whole input, as UTF-8.  ``kept`` holds the remaining bytes
    where some went, else null.
    Null and empty texts, and texts shorter than ``length``, lose nothing; repeated rows
    repeat each other and lose all if they are long enough; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    found = materialize(runs(rows.select("doc", "key", "text"), length, gram), "runs")

    # Buckets: one row for each different reach of a gram that stands at two places or more.
    place = F.struct("doc", "key", "low", "high", "at")
    reaches = found.groupBy("gram", "reach").agg(F.count("*").alias("held"), F.min(place).alias("first"))
    grams = reaches.groupBy("gram").agg(F.sum("held").alias("all"), F.sum((F.col("held") == 1).cast("long")).alias("open")).where("`all` > 1")
    buckets = materialize(reaches.join(grams, "gram").select("gram", "reach", "held", "open", "first"), "buckets")
    whole = materialize(found.join(buckets.where("held > 1").select("gram", "reach"), ["gram", "reach"], "left_semi").select(*ID, "low", "high"), "whole")
    discard(found)
    opened = buckets.where("open > 0").select("gram", (F.col("held") == 1).alias("single"), "first.*")

    # Only texts that may hold something repeated are looked at again.
    some = bitmap(whole.select("key").unionByName(opened.where("single").select("key")).distinct())
    texts = materialize(_texts(rows, kind, some), "texts")
    kept = texts.where("text is not null")
    contexts = materialize(_contexts(opened, kept, length), "contexts")

    blocks = materialize(_blocks(contexts, length), "blocks")
    by_reach = blocks.groupBy("reach").agg(F.count("*").alias("held"), F.first("core").alias("core"), F.min(F.struct("node", "block", "single")).alias("first"))
    by_reach = materialize(by_reach, "reaches")
    active = (F.col("held") == 1) & F.col("first.single")
    cores = by_reach.groupBy("core").agg(F.count("*").alias("kinds"), F.sum(active.cast("long")).alias("active")).where("kinds > 1 and active > 0").select("core")
    again = by_reach.join(cores, "core", "left_semi").select("first.node", "first.block", active.alias("active"))
    settled = blocks.where("single").join(by_reach.where("held > 1").select("reach"), "reach", "left_semi").select(*ID, "low", "high")

    positions = materialize(_positions(contexts, again, length), "positions")
    twice = positions.groupBy("string").agg(F.count("*").alias("held")).where("held > 1").select("string")
    single = positions.where("active").join(twice, "string", "left_semi").select(*ID, F.col("low"), F.col("low").alias("high"))

    spans = whole.unionByName(settled).unionByName(single)
    spans = spans.groupBy(*ID).agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    return _cut(texts, spans, kind, length, id_col, with_kept)


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _texts(rows: DataFrame, kind: str, some: np.ndarray) -> DataFrame:
    """Rows that hold nothing repeated are answered, the others keep their text."""
    shared = rows.sparkSession.sparkContext.broadcast(some)

    def run(batches):
        for batch in batches:
            texts = batch["text"].to_pylist()
            data = [None if h else _bytes(t) for h, t in zip(may_hold(shared.value, batch["key"].to_numpy()), texts)]
            yield {
                "_id": batch["_id"],
                "doc": batch["doc"],
                "key": batch["key"],
                "n_bytes": [None if d is None else len(d) for d in data],
                "kept_sha256": [None if d is None else hashlib.sha256(d).hexdigest() for d in data],
                "text": [t or "" if d is None else None for d, t in zip(data, texts)],
            }

    return map_columns(rows, run, f"_id {kind}, doc long, key long, n_bytes long, kept_sha256 string, text string")


def _contexts(opened: DataFrame, kept: DataFrame, length: int) -> DataFrame:
    """(node, doc, key, low, high, at, single, bytes): the open runs and representatives with all their strings."""
    own = opened.groupBy(*ID).agg(F.collect_list(F.struct("gram", "single", "low", "high", "at")).alias("own"))
    texts = kept.groupBy(*ID).agg(F.first("text").alias("text"))
    names = ["node", "doc", "key", "low", "high", "at", "gram", "single", "bytes"]

    def run(batches):
        for batch in batches:
            out = []
            for doc, key, text, own in zip(batch["doc"], batch["key"], batch["text"], batch["own"]):
                data = _bytes(text)
                for r in own:
                    node = hash((doc, key, r["low"])) & 0x7FFFFFFFFFFFFFFF
                    out.append((node, doc, key, r["low"], r["high"], r["at"], r["gram"], r["single"], data[r["low"] : r["high"] + length]))
            yield pd.DataFrame(out, columns=names)

    schema = "node long, doc long, key long, low long, high long, at long, gram long, single boolean, bytes binary"
    return texts.join(own, ID).mapInPandas(run, schema)


class _Joined:
    """The byte strings of a batch as one, so that all their spans are hashed at once."""

    def __init__(self, batch: pd.DataFrame):
        sizes = np.array([len(b) for b in batch["bytes"]], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.prefix = Prefix(b"".join(batch["bytes"]))


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the counted things: the index of its owner and its number there."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _slices(batches, rows: int = 2000):
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows].reset_index(drop=True)


def _blocks(contexts: DataFrame, length: int) -> DataFrame:
    """The blocks of every run by displacement from the anchor, with the hashes of their reach and their common core."""

    def run(batches):
        for batch in _slices(batches):
            joined = _Joined(batch)
            low, high, at = (batch[c].to_numpy() for c in ("low", "high", "at"))
            least, most = (at - high) // BLOCK, (at - low) // BLOCK
            own, k = _spread(most - least + 1)
            block = least[own] + k
            near = np.maximum(block * BLOCK, (at - high)[own])  # displacements of this run in the block
            far = np.minimum(block * BLOCK + BLOCK - 1, (at - low)[own])
            base = joined.starts[own] + (at - low)[own]  # of the anchor in the joined bytes
            gram = batch["gram"].to_numpy().view(np.uint64)[own]
            tag = mix(gram + block.astype(np.uint64))
            reach = joined.prefix.spans(base - far, base - near + length) ^ mix(tag + near.astype(np.uint64) * np.uint64(4096) + far.astype(np.uint64))
            core_from, core_to = base - block * BLOCK, base - block * BLOCK - BLOCK + 1 + length
            # The core lies within any string of the block, so within the run's bytes.
            core = joined.prefix.spans(core_from, core_to) ^ tag
            yield pd.DataFrame(
                {
                    "node": batch["node"].to_numpy()[own],
                    "block": block,
                    "single": batch["single"].to_numpy()[own],
                    "reach": reach.view(np.int64),
                    "core": core.view(np.int64),
                    "doc": batch["doc"].to_numpy()[own],
                    "key": batch["key"].to_numpy()[own],
                    "low": at[own] - far,
                    "high": at[own] - near,
                }
            )

    return contexts.mapInPandas(run, "node long, block long, single boolean, reach long, core long, doc long, key long, low long, high long")


def _positions(contexts: DataFrame, again: DataFrame, length: int) -> DataFrame:
    """Each position of the blocks in ``again`` with the hash of its string."""
    wanted = again.groupBy("node").agg(F.collect_list(F.struct("block", "active")).alias("wanted"))

    def run(batches):
        for batch in _slices(batches):
            joined = _Joined(batch)
            low, high, at = (batch[c].to_numpy() for c in ("low", "high", "at"))
            own = np.repeat(np.arange(len(batch)), [len(w) for w in batch["wanted"]])
            block = np.array([x["block"] for w in batch["wanted"] for x in w], np.int64)
            active = np.array([x["active"] for w in batch["wanted"] for x in w], bool)
            near = np.maximum(block * BLOCK, (at - high)[own])
            far = np.minimum(block * BLOCK + BLOCK - 1, (at - low)[own])
            which, k = _spread(far - near + 1)
            away = near[which] + k
            run_ = own[which]
            start = joined.starts[run_] + (at - low)[run_] - away
            gram = batch["gram"].to_numpy().view(np.uint64)[run_]
            string = joined.prefix.spans(start, start + length) ^ mix(gram + away.astype(np.uint64))
            yield pd.DataFrame({"string": string.view(np.int64), "active": active[which], "doc": batch["doc"].to_numpy()[run_], "key": batch["key"].to_numpy()[run_], "low": at[run_] - away})

    return contexts.join(wanted, "node").mapInPandas(run, "string long, active boolean, doc long, key long, low long")


def _cut(texts: DataFrame, spans: DataFrame, kind: str, length: int, id_col: str, with_kept: bool) -> DataFrame:
    """The answers: of texts with spans what remains of them, of the others the whole."""
    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist()):
                data = _bytes(text)
                removed, n, at, pieces = 0, 0, 0, []
                for a, b in _merged(spans, length):
                    pieces.append(data[at:a])
                    removed, n, at = removed + b - a, n + 1, b
                kept = b"".join([*pieces, data[at:]])
                out.append((len(data), removed, n, hashlib.sha256(kept).hexdigest(), kept if with_kept and n else None))
            yield {"_id": batch["_id"]} | by_name(out, [c.split()[0] for c in RESULT.split(", ")])

    held = texts.where("text is not null").select("_id", *ID, "text").join(spans, ID, "left").select("_id", "text", "spans")
    done = texts.where("text is null").select("_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept_sha256", F.lit(None).cast("binary").alias("kept"))
    out = done.unionByName(map_columns(held, run, f"_id {kind}, {RESULT}")).withColumnRenamed("_id", id_col)
    return out if with_kept else out.drop("kept")


def _merged(spans, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the strings that start in the given ranges."""
    if spans is None or not len(spans):
        return []
    places = np.array([(s["low"], s["high"] + length) for s in spans], np.int64)
    places = places[np.argsort(places[:, 0], kind="stable")]
    ends = np.maximum.accumulate(places[:, 1])
    new = np.flatnonzero(np.concatenate([[True], places[1:, 0] > ends[:-1]]))
    return list(zip(places[new, 0].tolist(), ends[np.append(new[1:], len(places)) - 1].tolist()))
