import random

import pytest
from pyspark.sql import functions as F

from flowloom.llm import near_duplicates as N
from flowloom.llm.components import components

from . import brute

SCHEMA = "doc_id long, text string"


def answers(frame):
    return {r[0]: (r[1], r[2], r[3]) for r in frame.collect()}


def family(rng, n_docs, n_words, most_edits):
    """Copies of one text with one to most_edits words changed."""
    base = [f"w{rng.randrange(400)}" for _ in range(n_words)]
    out = []
    for _ in range(n_docs):
        words = list(base)
        for _ in range(rng.randint(1, most_edits)):
            words[rng.randrange(n_words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_components_meet_brute_force(spark, percent):
    rng = random.Random(percent)
    texts = family(rng, 40, 100, 7) + family(rng, 12, 60, 3) + family(rng, 6, 30, 1)
    texts += texts[:3] + ["", None, " \t\n", "one", "ONE", "two words", "Two\x0bwords", "a b c d e", "A B C D E f", "É É É É É", "é é é é é"]
    rng.shuffle(texts)
    docs = dict(enumerate(texts))
    frame = spark.createDataFrame(list(docs.items()), SCHEMA).withColumn("n_shingles", F.lit(-1)).withColumn("rep", F.lit("clash"))
    assert answers(N.near_duplicates(frame, percent=percent)) == brute.near_duplicates(docs, percent)


def test_empty_table_null_ids_and_repeated_rows(spark):
    assert N.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    frame = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (7, "a b c d e f")], SCHEMA)
    found = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in N.near_duplicates(frame).collect())
    assert found == [("3", 3, True), ("3", 3, True), ("7", 3, False), ("None", 3, False)]


def test_tensored_tables_keep_the_promised_recall():
    m = N.hashes_each(0.85)
    assert (1 - (1 - 0.85**N.ROWS) ** m) ** 2 >= 1 - 5e-5
    assert 2 * m * N.ROWS < m * m  # fewer MinHash values than tables


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(17)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    expected = {n: find(n) for a, b in links if a != b for n in (a, b)}
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
