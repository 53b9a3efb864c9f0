import random

import pytest
from pyspark.sql import functions as F

from flowloom.llm import repeats as R
from flowloom.llm.anchors import Prefix, anchors, chosen

from . import brute

SCHEMA = "doc_id long, text string"


def pieces(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab é") for _ in range(rng.randint(30, 700))) for _ in range(5)]
    docs = {}
    for i in range(50):
        text = ""
        for _ in range(rng.randint(0, 4)):
            x = rng.choice(base)
            a = rng.randint(0, len(x))
            text += x[a : a + rng.randint(5, 400)]
        if text and rng.random() < 0.5:
            letters = list(text)
            for _ in range(rng.randint(1, 4)):
                letters[rng.randrange(len(letters))] = rng.choice("xyz")
            text = "".join(letters)
        docs[i] = text
    return docs | {50: None, 51: "", 52: "a" * 700, 53: "a" * 45, 54: "ab" * 200, 55: docs[3], 56: docs[4]}


@pytest.mark.parametrize("length, gram", [(40, 16), (60, 20)])
def test_removal_meets_brute_force(spark, length, gram):
    docs = pieces(length)
    frame = spark.createDataFrame(list(docs.items()), SCHEMA).withColumns({"key": F.lit("clash"), "low": F.lit(1)})
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in R.remove_repeats(frame, length, gram=gram).collect()}
    assert found == brute.repeats(docs, length)


def test_kept_bytes_repeated_rows_and_empty_table(spark):
    assert R.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(900))
    rows = R.remove_repeats(spark.createDataFrame([(1, text), (1, text), (None, "x" + text[:450])], SCHEMA), with_kept=True).collect()
    assert sorted((r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in rows) == [(451, 450, b"x"), (900, 900, b""), (900, 900, b"")]


def test_equal_windows_have_equal_anchors():
    rng = random.Random(4)
    text = bytes(rng.choice(b"abc") for _ in range(400))
    for data in (text, b"zz" + text + b"q", bytes([120]) * 300):
        low, high, at, _ = anchors(Prefix(data), len(data), 50, 20)
        places = {p: a - p for x, y, a in zip(low, high, at) for p in range(x, y + 1)}
        assert sorted(places) == list(range(len(data) - 49))
        seen = {}
        for p, away in places.items():
            assert seen.setdefault(data[p : p + 50], away) == away and 0 <= away <= 30


def test_every_stretch_holds_a_chosen_place():
    import numpy as np

    values = np.random.default_rng(1).integers(0, 1 << 60, 500).astype(np.uint64)
    at = chosen(values, 16)
    assert all(((at >= i) & (at < i + 16)).any() for i in range(485))
    assert len(chosen(values[:0], 16)) == 0 and chosen(values[:3], 16).tolist() == [int(values[:3].argmin())]
