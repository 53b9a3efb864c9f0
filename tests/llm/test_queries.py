"""Whole queries that SQL can't express, against plain versions on small tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from flowloom.llm import queries
from flowloom.llm.passages import common_words


def write(spark, folder, docs, bench=()):
    rows = [(k, t, lang, "src", None if t is None else len(t)) for k, t, lang in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(bench), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def language_words(text):
    return re.findall(r"[^\W\d_]+", (text or "").lower())


def plain_languages(docs):
    """Word-first backoff in dictionaries."""
    learn = [(language_words(t), lang) for k, t, lang in docs if zlib.crc32(str(k).encode()) % 3 != 1 and lang is not None and t is not None]
    langs = sorted({lang for _, lang in learn})
    tables = []
    for order in (0, 5, 4, 3, 2, 1):
        counts = {x: Counter() for x in langs}
        for words, lang in learn:
            for w in words:
                marked = f"\x02{w}\x03"
                counts[lang].update([w] if order == 0 else [marked[i : i + order] for i in range(len(marked) - order + 1)])
        kept = {x: dict(sorted(c.items(), key=lambda p: (-p[1], p[0]))[: 20_000 if order == 0 else 6_000]) for x, c in counts.items()}
        known = set().union(*kept.values())
        sums = {x: sum(c.values()) for x, c in kept.items()}
        table = {}
        for g in known:
            logs = [math.log((kept[x].get(g, 0) + 0.5) / (sums[x] + 0.5 * len(known))) for x in langs]
            table[g] = [v - sum(logs) / len(logs) for v in logs]
        tables.append((order, table))

    def score(w):
        for order, table in tables:
            marked = f"\x02{w}\x03"
            parts = [w] if order == 0 else [marked[i : i + order] for i in range(len(marked) - order + 1)]
            own = [table[g] for g in parts if g in table]
            if own:
                return [sum(x) / len(own) for x in zip(*own)]
        return [0.0] * len(langs)

    out = {}
    for k, t, _ in docs:
        words = [w for w in language_words(t) if any(c.isalpha() for c in w)]
        if not words:
            out[k] = ("und", 0.0)
            continue
        total = [sum(x) * min(1.0, 20 / len(words)) for x in zip(*map(score, words))]
        powers = [math.exp(x - max(total)) for x in total]
        best = total.index(max(total))
        out[k] = (langs[best], powers[best] / sum(powers))
    return out


def test_languages(spark, tmp_path):
    rng = random.Random(2)
    letters = {"aa": "abcdeth", "bb": "schöüei", "cc": "oñaáíbl"}
    lexicon = {x: ["".join(rng.choice(c) for _ in range(rng.randint(1, 7))) for _ in range(60)] for x, c in letters.items()}
    docs = []
    for i in range(150):
        lang = rng.choice(sorted(lexicon))
        words = [rng.choice(lexicon[lang] if rng.random() < 0.6 else lexicon[rng.choice(sorted(lexicon))]) + ("" if rng.random() < 0.8 else rng.choice("xyzt")) for _ in range(rng.randint(1, 40))]
        docs.append((i, rng.choice([" ", "  ", ", ", "\n"]).join(words), rng.choice([lang, lang, None])))
    docs += [(200, None, "aa"), (201, "", None), (202, "12 _ 34", "bb"), (203, "ZZZZ qqq", "cc")]
    found = {r["doc_id"]: r for r in queries.op2_language_id(spark, write(spark, tmp_path, docs)).collect()}
    expected = plain_languages(docs)
    assert {k: r["lang_pred"] for k, r in found.items()} == {k: x for k, (x, _) in expected.items()}
    assert all(abs(r["score"] - expected[k][1]) < 1e-9 and r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in found.items())


def bench_shingles(words):
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else Counter()


def test_decontamination(spark, tmp_path):
    """Every item at every place of every document, by the weighted likeness of its shingles."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    common = [word() for _ in range(8)]
    items = {i: [word() for _ in range(rng.choice([2, 5, 9, 15, 30, 80, 200]))] for i in range(30)}
    items[40] = common + [word() for _ in range(20)]
    items[41] = common + [word() for _ in range(20)]
    docs = {}
    for i in range(120):
        words = [word() for _ in range(rng.randint(0, 150))]
        if i % 2:
            held = list(items[rng.choice(sorted(items))])
            for _ in range(len(held) // 60 + (len(held) > 25 and i % 4 == 1)):
                held[rng.randrange(len(held))] = word()
            at = rng.randint(0, len(words))
            words[at:at] = held
        docs[i] = " ".join(words)
    folder = write(spark, tmp_path, [(k, t, "aa") for k, t in docs.items()] + [(500, None, None)], [(k, " ".join(w).upper()) for k, w in items.items()])
    long = {k: bench_shingles(w) for k, w in items.items() if len(w) >= 8}
    seen = Counter(s for c in long.values() for s in c)
    weight = lambda s: 1 + math.log(len(long) / max(1, seen.get(s, 1)))
    expected = {}
    for k, text in docs.items():
        words = text.split()
        for i, item in items.items():
            best = None
            for at in range(len(words) - min(len(item), len(words)) + 1):
                here = words[at : at + len(item)]
                if i not in long:
                    same = 1.0 if here == item else 0.0
                else:
                    a, b = long[i], bench_shingles(here)
                    both = sum(min(n, b[s]) * weight(s) for s, n in a.items() if s in b)
                    every = sum(n * weight(s) for s, n in a.items()) + sum(n * weight(s) for s, n in b.items()) - both
                    same = both / every if every else 0.0
                if same >= 0.8 and (best is None or same > best[1] + 1e-12):
                    best = (at, same)
            if best:
                expected[k, i] = best
    found = {(r["doc_id"], r["item_id"]): (r["first_word"], r["similarity"]) for r in queries.op5_benchmark_decontamination(spark, folder).collect()}
    assert set(found) <= set(expected) and len(found) >= 0.98 * len(expected) and len(expected) > 50
    # Of equally good places any may be named.
    assert all(abs(found[x][0] - expected[x][0]) <= 4 and abs(found[x][1] - expected[x][1]) < 1e-9 for x in found)


def best_local(a, b):
    """(words, identity) of the best local alignment at +1 for an equal word and -4 for an edit: it is positive from 0.8 on."""
    score = np.zeros(len(b) + 1)
    size, equal = np.zeros(len(b) + 1, int), np.zeros(len(b) + 1, int)
    best = (0.0, 0, 0)
    for x in a:
        new, n, e = np.zeros(len(b) + 1), np.zeros(len(b) + 1, int), np.zeros(len(b) + 1, int)
        for j, y in enumerate(b, 1):
            options = [(0.0, 0, 0), (score[j - 1] + (1 if x == y else -4), size[j - 1] + 1, equal[j - 1] + (x == y)), (score[j] - 4, size[j] + 1, equal[j]), (new[j - 1] - 4, n[j - 1], e[j - 1])]
            new[j], n[j], e[j] = max(options, key=lambda o: o[0])
            if new[j] > best[0]:
                best = (new[j], n[j], e[j])
        score, size, equal = new, n, e
    return best[1], best[2] / max(best[1], 1)


def test_shared_passages(spark, tmp_path):
    """The documents that share 50 words or more of an identity of 0.8 with an earlier one, by comparing all pairs."""
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(40)]
    word = lambda: rng.choice(vocabulary) if rng.random() < 0.3 else f"w{rng.randrange(10**6)}"
    passages = [[word() for _ in range(rng.choice([30, 60, 75, 90]))] for _ in range(8)]
    docs = {}
    for i in range(36):
        words = [word() for _ in range(rng.randint(20, 60))]
        if i % 3:
            p = list(rng.choice(passages))
            for _ in range(rng.choice([0, 1, 3, 6])):
                p[rng.randrange(len(p))] = word()
            at = rng.randint(0, len(words))
            words[at:at] = p
        docs[i] = words
    found = {r["doc_id"] for r in queries.op1_shared_passages(spark, write(spark, tmp_path, [(k, " ".join(w), "aa") for k, w in docs.items()])).collect()}
    sure, never = set(), set(docs)  # fewer than 40 words in common, in order, are no 50 words of that identity
    for b in docs:
        for a in range(b):
            n, same = best_local(docs[b], docs[a])
            if n >= 50 and same >= 0.85:
                sure.add(b)
            if common_words(*(np.array([zlib.crc32(w.encode()) for w in docs[k]]) for k in (a, b))) >= 40:
                never.discard(b)
    assert sure <= found and not found & never and len(sure) >= 8 and len(never) >= 8
