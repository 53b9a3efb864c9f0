"""Vector codes: product quantisation in whole numbers, entries found by partial distances.

A part's nearest codebook entry is searched dimension by dimension, those of the largest
variance among the entries first.  Entries go as soon as their sum so far exceeds the best
complete distance; masks drop them for whole blocks of vectors at a time.  All arithmetic is
on integers, so that codes don't depend on how rows are dealt out.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_name, map_columns, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries that are looked at together; each such set meets the best distance of those before.
SET = 16
#: Vectors of a block: bounds the (vector, entry) pairs in memory.
BLOCK = 4096
#: Whole numbers up to which squared distances of a part are surely 64-bit numbers, for parts of up to 2 ** 12 dimensions.
SMALL = 1 << 24
MOST = (1 << 63) - 1
LIMB = 40
#: Labels up to which their sums are broadcast (a checked size); beyond, both sides are salted.
MAX_BROADCAST_LABELS = 100_000
SALTS = 32


@dataclass(frozen=True)
class Codebooks:
    """For each part its entries (entry, dimension) and the order in which dimensions are summed."""

    entries: list[np.ndarray]
    orders: list[np.ndarray]

    @staticmethod
    def of(entries: list[np.ndarray]) -> Codebooks:
        # Variances by integers: n * sum of squares - squared sum; ties to the earlier dimension.
        orders = []
        for e in entries:
            x = e.astype(object)
            spread = [len(x) * sum(v * v for v in column) - sum(column) ** 2 for column in x.T]
            orders.append(np.array(sorted(range(len(spread)), key=lambda d: (-spread[d], d)), np.int64))
        return Codebooks(entries, orders)

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for e in self.entries for row in e.tolist() for v in row).encode()).hexdigest()


def nearest(x: np.ndarray, entries: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each row of ``x``; ties to the lower index."""
    n = len(x)
    best = np.full(n, MOST, x.dtype) if x.dtype != object else np.array([float("inf")] * n, object)
    code = np.zeros(n, np.int64)
    for begin in range(0, len(entries), SET):
        some = entries[begin : begin + SET]
        rows, which = (a.ravel() for a in np.indices((n, len(some))))
        sums = np.zeros(len(rows), x.dtype)
        for d in order:
            step = x[rows, d] - some[which, d]
            sums = sums + step * step
            alive = ~(sums > best[rows])
            if not alive.all():
                rows, which, sums = rows[alive], which[alive], sums[alive]
        # What is left is complete.  The last write wins: worse ones first, of equal ones the lower index last.
        at = np.lexsort((-which, -sums.astype(np.int64))) if x.dtype != object else np.array(sorted(range(len(rows)), key=lambda i: (-sums[i], -which[i])), np.int64)
        rows, which, sums = rows[at], which[at], sums[at]
        if len(rows):
            found = np.full(n, -1, np.int64)
            found[rows] = np.arange(len(rows))
            hit = np.flatnonzero(found >= 0)
            better = hit[sums[found[hit]] < best[hit]] if begin else hit
            best[better], code[better] = sums[found[better]], which[found[better]] + begin
    return code, best


def whole(vectors: pa.Array, length: int) -> np.ndarray:
    """floor(SCALE * component) by row, as 64-bit numbers where they surely do, else as Python's."""
    values = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, length)
    small = not values.size or float(np.abs(values).max()) < SMALL / SCALE
    if small:
        return np.floor(values * SCALE).astype(np.int64)
    from fractions import Fraction

    return np.array([[int(Fraction(v) * SCALE // 1) for v in row] for row in values.tolist()], object).reshape(-1, length)


def _bounds(length: int, parts: int) -> list[int]:
    """Where parts begin and end; if they can't be equal, the first ones are longer by one."""
    return [i * (length // parts) + min(i, length % parts) for i in range(parts + 1)]


def _blocks(batch, length: int, bounds: list[int]):
    """(first row, values by part) of blocks of a batch's vectors."""
    vectors = batch["_vector"]
    for begin in range(0, len(vectors), BLOCK):
        x = whole(vectors.slice(begin, BLOCK), length)
        yield begin, [x[:, a:b] for a, b in zip(bounds, bounds[1:])]


def _find(x: np.ndarray, book: np.ndarray, order: np.ndarray):
    kind = object if object in (x.dtype, book.dtype) else np.int64
    return nearest(x.astype(kind), book.astype(kind), order)


def _kept(rows: DataFrame, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return rows.where(v.isNotNull() & ~F.exists(v, bad)).withColumn("_vector", v)


def _first_books(kept: DataFrame, entries: int, parts: int) -> tuple[int, list[np.ndarray]]:
    """The vectors' length and the codebooks of the ``entries`` smallest ids."""
    first = kept.select("_id", "_vector").orderBy(F.col("_id").asc_nulls_last(), "_vector").limit(1).toArrow()
    length = len(first["_vector"][0]) if len(first) else 0
    rows = kept.where(F.size("_vector") == length).select("_id", "_vector").orderBy(F.col("_id").asc_nulls_last(), "_vector").limit(entries).toArrow()
    if not len(rows):
        return 0, []
    x = whole(rows["_vector"].combine_chunks(), length)
    bounds = _bounds(length, parts)
    return length, [x[:, a:b] for a, b in zip(bounds, bounds[1:])]


def _limbs(x: int) -> list[int]:
    """``x`` as 40-bit limbs of its sign, the lowest first; one at least."""
    out, sign, x = [], -1 if x < 0 else 1, abs(x)
    while x or not out:
        out.append(sign * (x & ((1 << LIMB) - 1)))
        x >>= LIMB
    return out


def _moved(kept: DataFrame, length: int, books: Codebooks) -> Codebooks:
    """Each entry replaced by floor(sum / count) of the parts that are nearest to it; unused ones stay.

    Tasks send one row for each used part, entry and dimension.
    """
    shared = kept.sparkSession.sparkContext.broadcast(books)
    bounds = _bounds(length, len(books.entries))

    def run(batches):
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            for _, parts in _blocks(batch, length, bounds):
                for p, (x, book, order) in enumerate(zip(parts, shared.value.entries, shared.value.orders)):
                    code, _ = _find(x, book, order)
                    for e in np.unique(code).tolist():
                        own = x[code == e]
                        held = sums.setdefault((p, e), [0, [0] * x.shape[1]])
                        held[0] += len(own)
                        held[1] = [a + int(b) for a, b in zip(held[1], own.sum(axis=0))]
        rows = [(p, e, d, k, limb, n) for (p, e), (n, total) in sums.items() for d, s in enumerate(total) for k, limb in enumerate(_limbs(s))]
        yield by_name(rows, names)

    # Whole numbers of any size add up as limbs: 2 ** 23 tasks' limbs of 40 bits are a 64-bit number.
    names = ["part", "entry", "dim", "limb", "sum", "n"]
    found = map_columns(kept.select("_vector"), run, "part int, entry int, dim int, limb int, sum long, n long")
    found = found.groupBy("part", "entry", "dim", "limb").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n")).collect()  # a number for each component of a codebook
    totals: dict[tuple[int, int, int], int] = {}
    counts = {}
    for r in found:
        at = r["part"], r["entry"], r["dim"]
        totals[at] = totals.get(at, 0) + (r["sum"] << (LIMB * r["limb"]))
        if not r["limb"]:
            counts[at] = r["n"]
    entries = [e.astype(object) for e in books.entries]
    for (part, entry, dim), total in totals.items():
        entries[part][entry, dim] = total // counts[part, entry, dim]
    fits = [e.astype(np.int64) if all(abs(v) < SMALL for row in e for v in row) else e for e in entries]
    return Codebooks.of(fits)


def learn(kept: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> tuple[int, Codebooks]:
    """(length of the vectors, codebooks after ``rounds`` rounds) of rows with ``_id`` and ``_vector``."""
    length, first = _first_books(kept, entries, parts)
    books = Codebooks.of(first)
    same = kept.where(F.size("_vector") == length)
    for _ in range(rounds if first else 0):
        books = _moved(same, length, books)
    return length, books


def _label_sums(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the sum of ``error`` over equal labels (nulls are equal)."""
    # Labels as strings of their own, so that null is a key like the others.
    coded = coded.withColumn("_key", F.to_json(F.struct(F.col("label").alias("x"))))
    sums = coded.groupBy("_key").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    if sums.limit(MAX_BROADCAST_LABELS + 1).count() <= MAX_BROADCAST_LABELS:
        return coded.join(F.broadcast(sums), "_key").drop("_key")
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    spread = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(spread, ["_key", "_salt"]).drop("_key", "_salt")


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> DataFrame:
    """id, code, error, label_error and codebooks_sha256 of every vector.

    Rows whose vector is null or has null or non-finite components are left out.  The
    length is that of the vector with the smallest id; if ``parts`` doesn't divide it, the
    first parts are longer by one.  Vectors of another length keep their row, with a null
    code and error.  Null ids come after all others in choosing the first codebooks, and
    rows of one id are ordered by their vectors.  With fewer rows than ``entries`` the
    codebooks have one entry for each.  Errors beyond 64 bits are given as the largest
    64-bit number.  An empty table gives no rows; further columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part: 1 to 256 entries")
    kind = rows.schema[id_col].dataType.simpleString()
    label = rows.schema[label_col].dataType.simpleString()
    kept = _kept(rows.select(F.col(id_col).alias("_id"), F.col(label_col).alias("label"), F.col(vector_col)), vector_col).select("_id", "label", "_vector")
    length, books = learn(kept, entries, parts, rounds)
    shared = kept.sparkSession.sparkContext.broadcast(books)
    bounds = _bounds(length, parts)

    def run(batches):
        for batch in batches:
            codes, errors = [], []
            for _, own in _blocks(batch, length, bounds):
                code = np.empty((len(own[0]), parts), np.uint8)
                error = np.zeros(len(own[0]), object)
                for p, (x, book, order) in enumerate(zip(own, shared.value.entries, shared.value.orders)):
                    code[:, p], best = _find(x, book, order)
                    error = error + best.astype(object)
                codes.extend(row.tobytes().hex() for row in code)
                errors.extend(min(int(e), MOST) for e in error)
            yield {"vec_id": batch["_id"], "label": batch["label"], "code": codes, "error": errors}

    same = F.size("_vector") == length
    coded = map_columns(kept.where(same), run, f"vec_id {kind}, label {label}, code string, error long")
    others = kept.where(~same).select(F.col("_id").alias("vec_id"), "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    out = _label_sums(materialize(coded.unionByName(others), "codes"))
    return out.select(F.col("vec_id").alias(id_col), "code", "error", "label_error", F.lit(books.digest).alias("codebooks_sha256"))
