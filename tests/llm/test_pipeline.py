import random
import zlib

import numpy as np

import corpus_pipeline as C
from flowloom.llm import pii
from flowloom.llm.queries import tokenizer_path

from . import brute


def test_stages_meet_plain_versions(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(11)
    lexicon = {"aa": [f"{a}the{b}" for a in "bcd" for b in "xyzw"] + ["of", "and"], "bb": [f"{a}schö{b}" for a in "bcd" for b in "xyzw"] + ["der", "und"]}
    items = {i: " ".join(rng.choice(lexicon["aa"]) for _ in range(20)) for i in range(4)}
    docs = {}
    for i in range(60):
        lang = rng.choice(["aa", "bb"])
        words = [rng.choice(lexicon[lang]) for _ in range(rng.randint(20, 120))]
        if i % 10 == 1:
            words += ["write", "a.b@c.de"]
        if i % 15 == 2:
            words += items[i % 4].split()
        docs[i] = (" ".join(words), lang)
    for i in range(60, 70):
        words = docs[i - 60][0].split()
        words[len(words) // 2] = "changed"
        docs[i] = (" ".join(words), docs[i - 60][1])
    docs |= {70: (None, "aa"), 71: ("", "aa"), 72: ("12 34", None), 73: docs[5]}
    rows = [(k, t, lang, "src", None if t is None else len(t)) for k, (t, lang) in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left = {k: t for k, (t, _) in docs.items() if t and any(map(str.isalpha, t))}
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = frame.columns
    for (name, stage), n in zip(C.STAGES[:-1], range(4)):
        frame = C.materialize(stage(spark, frame, str(tmp_path)), name)
        assert frame.columns == columns
        if n == 1:
            left = {k: t for k, t in left.items() if brute.near_duplicates(left, 80)[k][2]}
        if n == 2:
            held = {k for k, t in left.items() for i in items.values() if i in t}
            assert held
            left = {k: t for k, t in left.items() if k not in held}
        if n == 3:
            left = {k: pii.redacted(t, pii.base_spans(t)) for k, t in left.items()}
            assert any("[EMAIL]" in t for t in left.values())
        found = {r["doc_id"]: r for r in frame.collect()}
        assert {k: r["text"] for k, r in found.items()} == left, name
        assert all(r["n_chars"] == len(r["text"]) and r["lang"] == docs[k][1] for k, r in found.items())
    packed = C.STAGES[-1][1](spark, frame, str(tmp_path)).collect()
    library = Tokenizer.from_file(tokenizer_path())
    crcs = {k: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for k, t in left.items()}
    assert {r["doc_id"]: r["ids_crc32"] for r in packed if r["piece"] == 0 and r["length"] < 1024} == crcs
    whole = C.run(spark, str(tmp_path)).collect()
    key = lambda rows: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(whole) == key(packed)
    assert C.ORACLE_SQL is None


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0
