"""Null ids beside large ones, repeated rows, one id with two texts, clashing columns and empty tables, for every operator."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from flowloom.llm import decontamination, fingerprints, language, licenses, near_duplicates, packing, passages, pii, repeats, urls
from flowloom.llm.queries import tokenizer_path

from . import brute

BIG = 2**53 + 1
SCHEMA = "doc_id long, text string"
CLASH = ["score", "lang_pred", "key", "text_", "_id", "n_chars", "spans", "variant", "source"]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    texts = [words(rng, 90) for _ in range(4)]
    long = words(rng, 30_000)
    return [(None, texts[0]), (BIG, texts[1]), (BIG, texts[1]), (BIG + 2, texts[1] + " more"), (7, None), (8, ""), (9, long), (10, texts[2]), (10, texts[3]), (None, None)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in CLASH}).coalesce(1)


def ids(found, column="doc_id"):
    return sorted((r[column] for r in found.collect()), key=str)


def operators(spark):
    bench = spark.createDataFrame([(1, "no such item stands in any of these texts at all")], "item_id long, text string")
    return {
        "language": lambda d: language.predict(d, language.fit(d.withColumn("lang", F.lit("aa"))), keep=("score", "source")),
        "repeats": repeats.remove_repeats,
        "personal_data": lambda d: pii.find(d, pii.fit(d)),
        "near_duplicates": near_duplicates.near_duplicates,
        "packing": lambda d: packing.pack_documents(d, tokenizer_path()).where("piece = 0"),
        "fingerprints": fingerprints.compare_neighbours,
        "urls": lambda d: urls.judge(d.withColumnRenamed("text", "url"), id_col="doc_id"),
        "identified": lambda d: language.identified(d, language.fit(d.withColumn("lang", F.lit("aa"))), -1.0, lang_col="lang_pred").unionByName(d.where("text is null or text = ''")),
        "redacted": lambda d: pii.redact(d, pii.fit(d)),
        "without_contaminated": lambda d: decontamination.without_contaminated(d, bench),
    }


@pytest.mark.parametrize("name", ["language", "repeats", "personal_data", "near_duplicates", "packing", "fingerprints", "urls", "identified", "redacted", "without_contaminated"])
def test_ids_come_back_as_they_are(spark, rows, frame, name):
    apply = operators(spark)[name]
    assert ids(apply(frame)) == sorted((k for k, _ in rows), key=str)
    assert apply(frame.limit(0)).count() == 0


def test_found_items_have_exact_ids(spark, rows, frame):
    bench = spark.createDataFrame([(BIG, rows[1][1]), (BIG + 4, " ".join(rows[1][1].split()[:4]))], "item_id long, text string")
    found = decontamination.contaminated(frame, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == sorted((k, i) for k in (BIG, BIG, BIG + 2) for i in (BIG, BIG + 4))


def test_licenses_and_passages_have_exact_ids(spark, rows, frame):
    own = spark.createDataFrame([(BIG, "Released under the MIT License."), (None, "x\nReleased under the MIT License.")], SCHEMA)
    assert ids(licenses.scan(own, licenses.catalogue(spark))) == [BIG, None]
    found = passages.shared_passages(frame).collect()
    assert [(r["doc_id"], r["source_doc_id"], r["n_words"]) for r in found] == [(BIG + 2, BIG, 90)]


def test_one_id_with_two_texts(spark):
    """Near duplicates: id 5 holds X and Y, X is near 9's text and Y is 3's, so all three are one group."""
    rng = random.Random(4)
    x, y, z = words(rng, 100).split(), words(rng, 100), words(rng, 100)
    near = " ".join([*x[:50], "other", *x[51:]])
    docs = [(5, " ".join(x)), (5, y), (9, near), (3, y), (20, z), (20, ""), (21, None)]
    found = near_duplicates.near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found) == sorted(
        [(5, 96, 3, False), (5, 96, 3, False), (9, 96, 3, False), (3, 96, 3, True), (20, 96, 20, True), (20, 0, 20, True), (21, 0, 21, True)]
    )


def test_passages_between_texts_of_one_id(spark):
    rng = random.Random(5)
    shared = words(rng, 80)
    docs = [(4, words(rng, 30) + " " + shared), (4, shared + " " + words(rng, 200)), (6, words(rng, 5) + " " + shared), (6, words(rng, 400))]
    found = passages.shared_passages(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sorted((r["doc_id"], r["source_doc_id"], r["n_words"]) for r in found) == [(4, 4, 80), (6, 4, 80)]


def test_repeats_meet_brute_force_beside_null_ids(spark):
    rng = random.Random(6)
    shared = words(rng, 30)
    texts = {BIG: shared + words(rng, 20), BIG + 1: words(rng, 9) + shared, 3: None}
    expected = brute.repeats(texts, 60)
    frame = spark.createDataFrame([*texts.items(), (None, words(rng, 40))], SCHEMA).coalesce(1)
    found = {r["doc_id"]: tuple(r)[1:] for r in repeats.remove_repeats(frame, length=60, gram=16).collect()}
    assert {k: v for k, v in found.items() if k is not None} == expected and found[None][1] == 0


def test_likenesses_meet_a_plain_version(spark, rows, frame):
    """Every row's digests and likenesses, over ranges that many partitions make."""
    import hashlib

    found = sorted((r["n_chars"], r["edited_sha256"], r["near_next"]) for r in fingerprints.compare_neighbours(frame.repartition(7)).collect())
    hashed = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = sorted(hashed, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["text"] or ""))
    texts = [r["text"] or "" for r in order]
    plain = []
    for t, after in zip(texts, texts[1:] + texts[:1]):
        q = len(t) // 4
        prints = [fingerprints.fingerprint(fingerprints.PrefixHash(fingerprints.code_points(x))) for x in (t, after)]
        plain.append((len(t), hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest(), fingerprints.likeness(*prints)))
    assert found == sorted(plain)


def test_pipeline_with_clashing_columns_and_null_ids(spark, rows, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, key long, text_ string, at timestamp"
    docs = [(k, t, "aa", "src", None if t is None else len(t), 0.5, "zz", BIG, "x", None) for k, t in rows]
    spark.createDataFrame(docs, kind).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in C.STAGES[:-1]:
        frame = C.materialize(stage(spark, frame, str(tmp_path)), name)
        assert frame.columns == [c.split()[0] for c in kind.split(", ")]
    kept = frame.collect()
    assert {r["doc_id"] for r in kept} == {None, BIG, 9, 10} and all(r["key"] == BIG and r["lang_pred"] == "zz" for r in kept)
    assert {r["doc_id"] for r in C.run(spark, str(tmp_path)).collect()} == {None, BIG, 9, 10}
