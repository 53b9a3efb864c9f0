import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import packing
from flowloom.llm.queries import tokenizer_path
from flowloom.llm.tokens import TokenBytes

SCHEMA = "doc_id long, text string"


def placed(slots):
    """{bin: [(offset, length)]}."""
    bins = {}
    for s in slots:
        for k in range(s.bins):
            for t in range(s.each):
                bins.setdefault(s.first + k, []).append((s.offset + t * s.length, s.length))
    return bins


def best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_gapless_complete_and_tight(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 1024])
    lengths = [min(capacity, max(1, int(rng.expovariate(rng.choice([2, 4, 20]) / capacity)))) for _ in range(800)]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    slots, bins = packing.plan(histogram, capacity)
    found = placed(slots)
    assert sorted(n for own in found.values() for _, n in own) == sorted(lengths)
    assert sorted(found) == list(range(bins))
    for own in found.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
        assert sum(3 * n > capacity for _, n in own) <= 2
    assert bins <= max(-(-sum(lengths) // capacity), sum(2 * n > capacity for n in lengths)) * 1.05 + 2
    assert bins <= best_fit(lengths, capacity) + 2


def test_plan_grows_with_the_capacity_not_the_corpus():
    rng = random.Random(1)
    base = {n: rng.randint(1, 50) for n in range(1, 257)}
    small, _ = packing.plan(base, 256)
    large, _ = packing.plan({n: c * 10**6 for n, c in base.items()}, 256)
    assert len(large) <= 8 * 256 and len(small) <= 8 * 256
    with pytest.raises(ValueError):
        packing.plan({300: 1}, 256)
    assert packing.plan({}, 256) == ([], 0)


def test_ids_meet_the_library():
    coder = TokenBytes(tokenizer_path())
    rng = random.Random(5)
    letters = [chr(rng.randrange(1, 0xD7FF)) for _ in range(200)] + list("abcdefgh ABC'\n\t 0123.,-  ") * 20
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert coder.encode(text) == coder._ids(text)
    for text in ("", " ", "<|endoftext|> x", "it's  we'll", "naïve café", "a" * 3000):
        assert coder.encode(text) == coder._ids(text)


def test_documents_round_trip(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(2)
    docs = {i: " ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 5, 30, 90, 400]))) for i in range(60)} | {60: None, 61: "", 62: "x " * 5000}
    frame = spark.createDataFrame(list(docs.items()), SCHEMA).withColumns({"length": F.lit("clash"), "piece": F.lit(0)})
    rows = packing.pack_documents(frame, tokenizer_path(), capacity=64).collect()
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(docs)
    for doc, own in by_doc.items():
        ids = np.array([*library.encode(docs[doc] or "", add_special_tokens=False).ids, 2], "<u4")
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // 64)
        at = 0
        for r in own:
            assert r["start"] == at and (r["piece"] == 0 or r["length"] == 64)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in by_bin.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b")], SCHEMA)
    assert sorted(r["offset"] for r in packing.pack_documents(twice, tokenizer_path()).collect()) == [0, 3]
