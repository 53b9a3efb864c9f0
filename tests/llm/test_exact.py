"""Exact duplicates against a plain grouping of lower-cased bytes."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowloom.llm import exact
from flowloom.llm.radix import Node, coincide, common, ends, insert

SCHEMA = "doc_id long, text string"


def low(text):
    return (text or "").encode().lower()


def plain(rows, owner):
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    best = max if owner == "largest" else min
    keep = {t: best((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return groups, Counter((i, keep[low(t)], len(groups[low(t)]), hashlib.sha256(low(t)).hexdigest()) for i, t in rows)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    short = [(i, "".join(rng.choice("abAB") for _ in range(rng.randrange(5)))) for i in range(300)]
    return [*short, (None, "ab"), (None, None), (2**60, "q" * 100_000), (2**60, "Q" * 100_000), (None, "zzz"), (5, "É"), (6, "é"), (7, "")]


@pytest.mark.parametrize("bits", [64, 0])
@pytest.mark.parametrize("owner", ["largest", "smallest"])
def test_owners(spark, rows, owner, bits):
    """With no bits of hash, texts of one length share a trie, which must tell them apart."""
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("row", "key", "first", "root", "_text")}).repartition(5)
    got = exact.exact_duplicates(frame, owner=owner, hash_bits=bits).collect()
    groups, expected = plain(rows, owner)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == expected
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in kept}) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_a_hot_text_meets_in_shares(spark):
    hot = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Copy of a text").otherwise(F.concat(F.lit("own "), "id")).alias("text"))
    got = exact.exact_duplicates(hot.repartition(40)).where("group_size > 1").agg(F.count("*"), F.min("keep_id"), F.max("keep_id"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(got) == (1334, 3999, 3999, 1)


def test_an_empty_table_gives_no_rows(spark):
    assert exact.exact_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_windows_that_are_let_go(spark, rows, monkeypatch):
    monkeypatch.setattr(exact, "WINDOW", 0)
    windows = exact._Windows()
    assert windows.first(1, b"abc", 5) == 5 and windows.first(1, b"abc", 6) == 6


@pytest.mark.parametrize("make", [str, str.encode])
def test_tries_hold_what_is_inserted(make):
    rng = random.Random(2)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(9))) for _ in range(80)}
    a, b = [Node(make("")) for _ in range(2)]
    for w in words:
        insert(a, make(w)).value = w
        if w.startswith("a"):
            insert(b, make(w)).value = w
    assert sorted(ends(a, 0)) == sorted((make(w), w) for w in words)
    assert a.size == len(words)
    assert sorted(coincide(a, 0, b, 0)) == sorted((w, w) for w in words if w.startswith("a"))
    assert [common(make(x), make(y), 1) for x, y in (("abc", "xabd"), ("abc", "xabc"), ("abc", "x"), ("abc", "xxbc"))] == [2, 3, 0, 0]
