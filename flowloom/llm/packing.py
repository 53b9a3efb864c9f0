"""Best-fit packing with large-item matching.

Token counts lie between 1 and the capacity, so the whole corpus is described by a
histogram of at most ``capacity`` numbers.  The packing is computed on that histogram:
lengths above a third of the capacity are matched greedily in pairs (two at most in a
bin), shorter ones then go, longest first, into the smallest gap that holds them.  Bins
that are filled alike are one pattern with a count, so the plan stays small whatever
the corpus holds; each piece finds its place from its rank among the pieces of its
length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_columns, materialize
from .tokens import TokenBytes

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: its token ids and ``end_id``, cut only beyond the capacity.

    Of a cut document every piece but the first is full.  A null text counts as empty,
    so it has the one piece of ``end_id``.  Repeated rows are cut each; ids may be null.
    """

    def cut(batches):
        coder = TokenBytes(tokenizer_path)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            out = []
            for row, text in enumerate(batch["_text"].to_pylist()):
                ids = coder.encode(text or "") + end
                n = len(ids) // 4
                at, size = 0, n % capacity or min(capacity, n)
                k = 0
                while at < n:
                    out.append((row, k, at, size, zlib.crc32(memoryview(ids)[4 * at : 4 * (at + size)])))
                    at, size, k = at + size, capacity, k + 1
            row, piece, start, length, crc = map(list, zip(*out)) if out else ([], [], [], [], [])
            yield {"doc_id": batch["_id"].take(pa.array(row, pa.int64())), "piece": piece, "start": start, "length": length, "ids_crc32": crc}

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    out = map_columns(rows, cut, PIECES)
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out


@dataclass(frozen=True)
class Slot:
    """``each`` pieces of one length in each of ``bins`` bins from bin ``first``, from ``offset`` on."""

    length: int
    rank: int
    first: int
    bins: int
    each: int
    offset: int


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Slot], int]:
    """The slots of a packing and its number of bins."""
    left = {n: c for n, c in histogram.items() if c > 0}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    slots: list[Slot] = []
    taken: Counter = Counter()
    bins = 0

    def put(length: int, first: int, count: int, each: int, offset: int) -> None:
        slots.append(Slot(length, taken[length], first, count, each, offset))
        taken[length] += count * each
        left[length] -= count * each

    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs of bins (first, count)
    order: list[int] = []  # the gaps that have runs, ascending

    def free(gap: int, first: int, count: int) -> None:
        if gap and count:
            if not gaps[gap]:
                insort(order, gap)
            gaps[gap].append((first, count))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for big in large:
        while left[big]:
            mate = next((n for n in large if n <= capacity - big and left[n] - (n == big) > 0), 0)
            count = left[big] if not mate else left[big] // 2 if mate == big else min(left[big], left[mate])
            if mate == big:
                put(big, bins, count, 2, 0)
            else:
                put(big, bins, count, 1, 0)
                if mate:
                    put(mate, bins, count, 1, big)
            free(capacity - big - mate, bins, count)
            bins += count

    for size in sorted((n for n in left if left[n]), reverse=True):
        while left[size]:
            at = bisect_left(order, size)
            if at < len(order):
                gap = order[at]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    order.pop(at)
            else:
                gap, first, count = capacity, bins, -(-left[size] // (capacity // size))
                bins += count
            each = gap // size
            whole = min(count, left[size] // each)
            if whole:
                put(size, first, whole, each, capacity - gap)
                free(gap - whole and gap - each * size, first, whole)
            rest = left[size] if whole < count else 0
            if rest:
                put(size, first + whole, 1, rest, capacity - gap)
                free(gap - rest * size, first + whole, 1)
            used = whole + (rest > 0)
            free(gap, first + used, count - used)
    return slots, bins


def pack(found: DataFrame, capacity: int = 1024, id_col: str = "doc_id", salts: int | None = None) -> DataFrame:
    """``found`` (from :func:`pieces`, written so that it isn't computed twice) with sequence_id and offset.

    Ranks among pieces of one length are counted in ``salts`` parts, so that no length
    has to meet in one task.  The slots are broadcast: their number depends on the
    capacity, not on the corpus.
    """
    spark = found.sparkSession
    salts = salts or max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = found.withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    parts = salted.groupBy("length", "_salt").count()
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most capacity rows
    slots, _ = plan(histogram, capacity)
    table = local_rows_of_slots(spark, slots)
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(id_col, "piece", "ids_crc32")) - 1)
    ranked = ranked.join(starts.select("length", "_salt", "_before"), ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("s_length")) & (F.col("_rank") >= F.col("s_rank")) & (F.col("_rank") < F.col("s_end")))
    k = F.col("_rank") - F.col("s_rank")
    return placed.select(
        id_col,
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("s_first") + F.floor(k / F.col("s_each"))).cast("long").alias("sequence_id"),
        (F.col("s_offset") + k % F.col("s_each") * F.col("length")).cast("long").alias("offset"),
    )


def local_rows_of_slots(spark, slots: list[Slot]) -> DataFrame:
    rows = [(s.length, s.rank, s.rank + s.bins * s.each, s.first, s.each, s.offset) for s in slots]
    return spark.createDataFrame(rows, "s_length long, s_rank long, s_end long, s_first long, s_each long, s_offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Cut and pack ``docs`` (doc_id, text): one row for each piece with its place.

    An empty table gives no rows; ties among equal lengths are broken by salt, id and piece.
    """
    found = materialize(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    return pack(found, capacity)
