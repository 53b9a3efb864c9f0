"""Spelling variants: words one edit apart, found by merging errata tries.

Two words that differ by one inserted, deleted or replaced code point agree before the
edit and after it.  Words are therefore grouped by their first or their last half, and each
group's trie is cut into heavy paths: at every node the light subtrees, with one character
skipped or replaced, are merged with the heavy one and with each other, smaller ones into
larger ones; keys that end at one place are one edit apart.  Groups that are too large for
a task are halved again by what their words have in common.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmaps import bitmap, held
from .common import LOWER, UPPER, by_name, discard, map_columns, materialize
from .radix import Node, coincide, ends, insert

#: Distinct words that a task counts before it sends them on.
KEEP = 300_000
#: Words of a group that one trie holds; larger groups are halved.
MOST = 20_000

# Runs in lower-cased UTF-8: a letter is a-z or the bytes C3 80 to C3 BF.
_OTHER = re.compile(rb"[\xc2\xc4-\xf4][\x80-\xbf]+")
_TABLE = bytes(c if 97 <= c <= 122 or 0x80 <= c <= 0xBF or c == 0xC3 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def runs(text: bytes) -> list[bytes]:
    """The maximal runs of A-Z, a-z and U+00C0 to U+00FF in valid UTF-8, A-Z lower-cased."""
    if not text.isascii():
        text = _OTHER.sub(b" ", text)
    return text.translate(_TABLE).split()


def without(run: bytes, at: int) -> bytes:
    """``run`` without its code point number ``at``."""
    text = run.decode()
    return (text[:at] + text[at + 1 :]).encode()


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int = 199, min_length: int = 6, min_count: int = 5) -> DataFrame:
    """(word, n) of the runs of all texts, lower-cased, from ``min_length`` code points and ``min_count`` occurrences on.

    If ``damage`` divides the unsigned crc32 h of ``<id>:<run>``, the run's code point
    h % length is deleted (0: none is).  A null text has no runs, a null id is written as
    nothing.  Tasks send partial counts of bounded size.
    """

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            ids = [b"" if i is None else str(i).encode() for i in batch["_id"].to_pylist()]
            for doc, text in zip(ids, batch["_text"].cast(pa.binary()).to_pylist()):
                if not text:
                    continue
                start = zlib.crc32(doc + b":")
                own = Counter([r for r in runs(text) if len(r) >= min_length])  # bytes are no fewer than code points
                for r in own if damage else ():
                    h = zlib.crc32(r, start)
                    if h % damage == 0:
                        n = own[r]
                        total[without(r, h % len(r.decode()))] += n
                        total[r] -= n
                total.update(own)
                if len(total) > KEEP:
                    yield _columns(total)
                    total = Counter()
        yield _columns(total)

    def _columns(total):
        items = [(w.decode(), n) for w, n in total.items() if n and len(w) >= min_length]
        return by_name(items, ["word", "n"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    counts = map_columns(rows, run, "word string, n long").where(F.length("word") >= min_length)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def trie_pairs(middles: list[str], depth: int):
    """(i, j) of distinct ``middles`` that are one edit apart after fewer than ``depth`` equal code points, each pair once.

    Tries part at the end of what two words have in common, so every pair is met at one
    node, and one of the two lies in a light subtree there.
    """
    root = Node("")
    for i, middle in enumerate(middles):
        insert(root, middle).value = i
    todo = [(root, 0)]
    while todo:
        node, at = todo.pop()
        if at >= depth or not node.children:
            continue
        children = sorted(node.children.values(), key=lambda c: c.size)
        todo.extend((c, at + len(c.label)) for c in children)
        if node.value is not None:  # the shorter word ends here
            yield from ((node.value, c.value) for c in children if len(c.label) == 1 and c.value is not None)
        heavy = children.pop()
        errata = Node("")  # the light subtrees so far, without their first character
        for light in children:
            first = light.label[0]
            yield from coincide(light, 1, heavy, 1)  # replaced
            if len(children) > 1:
                yield from ((i, j) for i, others in coincide(light, 1, errata, 0) for j in others)
                for rest, i in ends(light, 1):
                    place = insert(errata, rest)
                    place.value = [i] if place.value is None else [*place.value, i]
            # The light word has one more character: skipped, it goes on as some other child does.
            if len(light.label) > 1:
                after = [(light, 1)] if light.label[1] != first and light.label[1] in node.children else []
            else:
                after = [(c, 0) for f, c in light.children.items() if f != first and f in node.children]
            for longer, i in after:
                yield from coincide(longer, i, node.children[longer.label[i]], 0)
            # The heavy word has one more character: skipped, it goes on as the light one.
            if len(heavy.label) > 1:
                if heavy.label[1] == first:
                    yield from coincide(heavy, 1, light, 0)
            elif first in heavy.children:
                yield from coincide(heavy.children[first], 0, light, 0)


def group_pairs(words: list[str], least: int, lo: int, hi: int):
    """Pairs of ``words`` that are one edit apart, whose common prefix is from ``lo`` to ``hi`` - 1 code points.

    All share their first ``lo`` code points and what follows the first ``hi`` of a word of
    ``least``; they have ``least`` code points or one more, and one of a pair has ``least``.
    """
    tail = max(0, least - hi)
    middles = [w[lo : len(w) - tail] for w in words]
    for i, j in trie_pairs(middles, hi - lo):
        if least in (len(words[i]), len(words[j])):
            yield i, j


def _key(word, least, lo, hi):
    """The column of what a group shares: 64-bit hashes part groups and words of a group are compared in full."""
    return F.xxhash64(least, lo, hi, F.substring(word, F.lit(1), lo), F.right(word, F.greatest(F.lit(0), least - hi)))


def _halved(rows: DataFrame, begin, end) -> DataFrame:
    """Rows (word, n, least) twice, for the edits from ``begin`` and from the middle to ``end``."""
    mid = F.floor((begin + end) / 2).cast("int")
    spans = F.explode(F.array(F.struct(begin.alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), end.alias("hi"))))
    out = rows.select("word", "n", "least", spans.alias("_s")).select("word", "n", "least", F.col("_s.lo").alias("lo"), F.col("_s.hi").alias("hi"))
    return out.where("lo < hi").withColumn("key", _key(F.col("word"), F.col("least"), F.col("lo"), F.col("hi")))


def _groups(words: DataFrame, most: int) -> DataFrame:
    """(word, n, least, lo, hi, key): each word in the groups where it can meet a near word."""
    size = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("least")).where("least >= 0")
    rows = materialize(_halved(rows, F.lit(0), F.col("least") + 1), "spelling-groups")
    parts = []
    while True:
        large = rows.where("hi - lo > 1").groupBy("key").count().where(F.col("count") > most).select("key")
        large = materialize(large, "spelling-large")
        if large.isEmpty():
            parts.append(rows)
            break
        # A group that the bitmap takes for a large one is halved as well, which changes no result.
        bits = words.sparkSession.sparkContext.broadcast(bitmap(large))

        def mark(batches, bits=bits):
            for batch in batches:
                many = held(bits.value, batch["key"].to_numpy())
                yield {c: batch[c] for c in batch.schema.names} | {"large": pa.array(many)}

        names = "word string, n long, least int, lo int, hi int, key long"
        marked = map_columns(rows, mark, names + ", large boolean").withColumn("large", F.expr("large and hi - lo > 1"))
        marked = materialize(marked, "spelling-marked")
        discard(rows, large)
        parts.append(marked.where("not large").drop("large"))
        rows = materialize(_halved(marked.where("large"), F.col("lo"), F.col("hi")), "spelling-groups")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n, near, near_n) of the distinct ``words`` (word, n) one edit apart, both ways round."""

    def run(batches):
        group, key = [], None  # of one key: (word, n, least, lo, hi)

        def settle():
            by_shape: dict[tuple, list] = {}
            for w, n, least, lo, hi in group:  # two groups may share a hash
                shape = least, lo, hi, w[:lo], w[len(w) - max(0, least - hi) :]
                by_shape.setdefault(shape, []).append((w, n))
            for (least, lo, hi, _, _), own in by_shape.items():
                if len(own) > 1:
                    for i, j in group_pairs([w for w, _ in own], least, lo, hi):
                        (a, m), (b, n) = own[i], own[j]
                        yield a, m, b, n
                        yield b, n, a, m

        for batch in batches:
            out = []
            for k, *row in zip(*(batch[c].to_pylist() for c in ("key", "word", "n", "least", "lo", "hi"))):
                if k != key:
                    if len(group) > 1:
                        out.extend(settle())
                    group, key = [], k
                group.append(row)
            yield by_name(out, names)
        if len(group) > 1:
            yield by_name(list(settle()), names)

    names = ["word", "n", "near", "near_n"]
    rows = _groups(words, most).repartition("key").sortWithinPartitions("key")
    return map_columns(rows, run, "word string, n long, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms (word, form) followed to the last word; ways are doubled in each round."""
    ways = materialize(forms.select("word", F.col("form").alias("root")), "spelling-ways")
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = ways.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        longer = materialize(longer, "spelling-ways")
        discard(ways)
        ways = longer.select("word", "root")
        ways.scratch_path = longer.scratch_path
        if longer.where("moved").isEmpty():
            return ways


def variants(words: DataFrame, ratio: int = 5, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near and form_n of distinct ``words`` (word, n).

    The form is the near word of the largest n, of equal ones the smallest in code-point
    order, if that n is at least ``ratio`` (over 1) times the word's; root follows forms to
    the last.  A word without a form is its own root.  Null words are left out; an empty
    table gives no rows.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1, else forms could go in a circle")
    words = materialize(words.where("word is not null").select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_words(words, most).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    near = materialize(near.select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")), "spelling-near")
    found = words.join(near, "word", "left")
    named = F.col("form_n") >= ratio * F.col("n")
    found = materialize(found.select("word", F.when(named, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(named, F.col("form_n")).alias("form_n")), "spelling-forms")
    roots = _roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int = 199, min_length: int = 6, min_count: int = 5, ratio: int = 5) -> DataFrame:
    """:func:`variants` of the words that :func:`count_words` finds in ``docs``."""
    return variants(count_words(docs, id_col, text_col, damage, min_length, min_count), ratio)
