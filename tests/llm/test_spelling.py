"""Spelling variants against deletion dictionaries and a regular expression."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowloom.llm import spelling as S


def plain_words(rows, damage=199, min_length=6, min_count=5):
    out = Counter()
    lower = str.maketrans(S.UPPER, S.LOWER)
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % damage == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            out[r] += 1
    return {w: n for w, n in out.items() if len(w) >= min_length and n >= min_count}


def plain_variants(words, ratio=5):
    near, cuts, form = {w: set() for w in words}, {}, {}
    for w in words:
        for i in range(len(w)):
            d = w[:i] + w[i + 1 :]
            if d in words:
                near[w].add(d)
                near[d].add(w)
            cuts.setdefault((i, d), []).append(w)
    for ws in cuts.values():
        for a in ws:
            near[a].update(b for b in ws if b != a)
    for w in words:
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= ratio * words[w]:
                form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("letters", "length", "n"), [("ab", 7, 300), ("abc", 5, 400), ("aé", 9, 500), ("abcdefgh", 3, 400)])
@pytest.mark.parametrize("most", [20_000, 3])
def test_variants(spark, letters, length, n, most):
    """Few letters make dense networks of near words; at most three words a group halves almost all of them."""
    rng = random.Random(5)
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(length + 1))): rng.choice([1, 5, 30, 200]) for _ in range(n)}
    got = S.variants(spark.createDataFrame([*words.items(), (None, 9)], "word string, n long"), most=most)
    assert sorted(map(tuple, got.collect()), key=str) == plain_variants(words)


def test_words_of_texts(spark):
    odd = "Straße STRASSE Éclair éclair naïve’quoted日本語word ×÷aaaaaa x1y2z3abcdefg ퟿abcdefgh\U0001f600ijklmnop Āzzzzzzz"
    rows = [(None, odd), (2**60, odd * 4), (3, None), (4, ""), (5, "a" * 50_000 + " " + "a" * 50_001), *[(i, f"{odd} wordsmith{i} vocabulary") for i in range(600)]]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("word", "n", "_id", "_text")})
    for damage in (199, 3):
        got = {r["word"]: r["n"] for r in S.count_words(frame, damage=damage, min_count=1).collect()}
        assert got == plain_words(rows, damage=damage, min_count=1)
    found = S.spelling_variants(frame, damage=3)
    assert sorted(map(tuple, found.collect()), key=str) == plain_variants(plain_words(rows, damage=3))


def test_long_words_are_near(spark):
    long = "ab" * 20_000
    words = {long: 5, long[:-1]: 50, "c" + long[1:]: 5, long[:17] + "x" + long[17:]: 5}
    got = S.variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert {(r["n_near"], r["form"] == long[:-1]) for r in got.collect()} == {(3, True), (1, False)}


def test_empty_tables(spark):
    assert S.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert S.spelling_variants(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        S.variants(spark.createDataFrame([], "word string, n long"), ratio=1)
