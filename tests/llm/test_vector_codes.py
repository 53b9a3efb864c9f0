"""Vector codes against plain loops over Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int"
MOST = (1 << 63) - 1


def plain(rows, entries=64, parts=16, rounds=2):
    kept = sorted(((i, v, k) for i, v, k in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: r[0])
    whole = [[math.floor(256 * x) for x in v] for _, v, _ in kept]
    width = len(whole[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def near(x, book):
        far = [sum((a - c) ** 2 for a, c in zip(x, e)) for e in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for v in cut:
                own.setdefault(near(v[p], books[p])[0], []).append(v[p])
            for e, vs in own.items():
                books[p][e] = [sum(c) // len(vs) for c in zip(*vs)]
    found = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    errors = [min(MOST, sum(d for _, d in f)) for f in found]
    sums = {}
    for (_, _, label), e in zip(kept, errors):
        sums[label] = sums.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((i, "".join("%02x" % e for e, _ in f), error, min(MOST, sums[label]), digest) for (i, _, label), f, error in zip(kept, found, errors))


def table(scale, n=200, length=32):
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(-3, 4)) * scale / 256 for _ in range(length)], rng.choice([None, 1, 2])) for i in range(n)]
    return [*rows, (1000, None, 1), (1001, [None] * length, 1), (1002, [float("nan")] * length, 2), (1003, [float("-inf")] + [0.0] * (length - 1), None)]


@pytest.mark.parametrize("scale", [0.3, 1, 1e9])
def test_codes(spark, scale):
    """Small whole numbers give many ties; at 1e9 squares need more than 64 bits."""
    rows = table(scale)
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("code", "error", "_id", "_vector", "dim")}).repartition(4)
    assert sorted(map(tuple, V.compress(frame).collect())) == plain(rows)


def test_fewer_rows_than_entries_and_salted_labels(spark, monkeypatch):
    rows = table(1, n=20)
    monkeypatch.setattr(V, "MAX_BROADCAST_LABELS", 0)
    assert sorted(map(tuple, V.compress(spark.createDataFrame(rows, SCHEMA)).collect())) == plain(rows)


def test_odd_vectors(spark):
    assert V.compress(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, [1.0] * 5, None), (1, [1e300] * 17, 2), (1, [3.0] * 17, 2), (2, [], 1)]
    got = {(r["vec_id"], r["code"], r["error"]) for r in V.compress(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(None, None, None), (2, None, None), (1, "00" * 16, 0), (1, "01" * 16, 0)}


def test_partial_distances_drop_only_what_is_farther():
    rng = np.random.default_rng(1)
    x, book = rng.integers(-9, 10, (500, 6)), rng.integers(-9, 10, (40, 6))
    order = V.Codebooks.of([book]).orders[0]
    spread = book.var(axis=0)
    assert all(spread[a] >= spread[b] - 1e-9 for a, b in zip(order, order[1:]))
    far = ((x[:, None] - book) ** 2).sum(axis=2)
    code, best = V.nearest(x, book, order)
    assert (code == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()
