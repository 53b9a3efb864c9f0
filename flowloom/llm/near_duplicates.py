"""Near-duplicate documents by MinHash with tensored banding.

Two collections of ``m`` short hashes each (``ROWS`` MinHash values to a hash) stand for
``m * m`` tables: the key of a table is a pair of hashes, one of each collection.  So the
MinHash values to compute grow with the root of the number of tables.  Candidates of a
table are confirmed on their full sets of word shingles; shingles that only one class has
rule out, before any texts meet, what can't be linked.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_name, discard, map_columns, materialize
from .components import components
from .words import WordHasher, mix

ROWS = 3
SALTS = 16
STEP = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes."""

    def __init__(self, size: int = 5):
        self._size, self._hasher = size, WordHasher()

    def shingles(self, text: str | None) -> np.ndarray:
        """A-Z lower-cased, words between ASCII white space; fewer words than the size are one shingle, none give none."""
        words = self._hasher.hashes((text or "").encode("utf-8", "surrogatepass").lower().split())
        if not len(words):
            return words
        n = min(self._size, len(words))
        out = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            out = mix(out * STEP + words[k : len(words) - n + 1 + k])
        return np.unique(out)


def hashes_each(similarity: float, miss: float = 5e-5) -> int:
    """The size m of a collection for which a pair of that similarity is missed with probability ``miss`` at most."""
    return math.ceil(math.log(miss / 2) / math.log(1 - similarity**ROWS))


class Signer:
    """The 2 m short hashes of a set."""

    def __init__(self, m: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self._m = m
        self._factors = rng.integers(0, 1 << 63, 2 * m * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
        self._terms = rng.integers(0, 1 << 63, 2 * m * ROWS, np.uint64)
        self._slots = np.arange(1, 2 * m + 1, dtype=np.uint64)

    def sign(self, values: np.ndarray) -> np.ndarray:
        least = np.array([(values * a + b).min() for a, b in zip(self._factors, self._terms)], np.uint64).reshape(2 * self._m, ROWS)
        out = mix(self._slots)
        for k in range(ROWS):
            out = mix(out * STEP + least[:, k])
        return out.view(np.int64)


def signatures(docs: DataFrame, m: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, salt, n_shingles, set_id, halves) of every row; a row without words has no set and no halves."""

    def run(batches):
        shingler, signer = Shingler(size), Signer(m)
        for batch in batches:
            out = []
            for text in batch["_text"].to_pylist():
                s = shingler.shingles(text)
                out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), signer.sign(s)) if len(s) else (0, None, None))
            salts = np.arange(len(out), dtype=np.int32) % SALTS
            yield {"doc_id": batch["_id"], "salt": salts} | by_name(out, ["n_shingles", "set_id", "halves"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return map_columns(rows, run, "doc_id long, salt int, n_shingles long, set_id binary, halves array<long>")


def tables(classes: DataFrame, m: int) -> DataFrame:
    """(rep, n, keys): the table keys of each class that shares a hash of either collection with another class."""
    halves = classes.select("rep", "n_shingles", F.posexplode("halves").alias("slot", "half"))
    # Written, so that the join deals both sides anew and Spark may split a frequent hash.
    shared = materialize(halves.groupBy("half").agg(F.count("*").alias("held")).where("held > 1").select("half"), "shared")
    left = halves.join(shared, "half", "left_semi").groupBy("rep").agg(F.first("n_shingles").alias("n"), F.collect_list(F.struct("slot", "half")).alias("own"))
    first = F.filter("own", lambda x: x.slot < m)
    second = F.filter("own", lambda x: x.slot >= m)
    keys = F.flatten(F.transform(first, lambda x: F.transform(second, lambda y: F.xxhash64(x.half, y.half))))
    return left.select("rep", "n", keys.alias("keys")).where(F.size("keys") > 0)


def confirm(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike."""

    def run(batches):
        shingler = Shingler(size)
        last = None
        for batch in batches:
            out = []
            for a, b, left, right in zip(batch["a"], batch["b"], batch["left"], batch["right"]):
                if last is None or last[0] != a:
                    last = (a, shingler.shingles(left))
                x, y = last[1], shingler.shingles(right)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both) and both:
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"])

    rows = pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("right")), "b")
    rows = rows.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("left")), "a")
    return rows.select("a", "b", "left", "right").mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    Documents are linked where 100 * intersection >= percent * union of their sets of
    ``size``-word shingles; the component is the smallest id reachable, and ``kept`` marks
    the document of that id.  Documents without words (null, empty, white space) are linked
    with nothing.  Rows of one id are one document with a set for each of its texts: it is
    linked with all that any of them is linked with, and ``n_shingles`` is of the row's
    own text.  A null id links nothing; its row has the component of the documents of its
    very set, if there are any, and is never kept.

    Documents of equal sets are one class.  In each table every class is first compared
    with the class of the smallest id there.  What tables with several components are
    left is settled exactly: shingles that no other class of those tables has can't be in
    an intersection, so with u of a class's n shingles its own, it is linked with nothing
    if 100 * (n - u) < percent * n, and two classes aren't linked if their n - u and
    n + u of the other rule it out.  Each table's remaining classes are compared with its
    class of the smallest share of own shingles, then the pairs that are still apart and
    not ruled out are compared, each in the first table that holds both.
    """
    m = hashes_each(percent / 100)
    signed = materialize(signatures(docs, m, size, id_col, text_col), "signatures")
    worded = signed.where("n_shingles > 0 and doc_id is not null")
    classes, ties = _classes(worded)
    keyed = materialize(tables(classes, m), "tables")
    rows = keyed.select("rep", "n", F.explode("keys").alias("key"))
    least = rows.groupBy("key").agg(F.min("rep").alias("least"), F.count("*").alias("held")).where("held > 1")
    least = materialize(least.select("key", "least"), "least")
    # (rep, n, key, least) of the tables with several classes
    held = materialize(rows.join(least, "key"), "held")
    discard(keyed)
    texts = materialize(_texts_of(docs, held.select("rep").distinct(), classes if ties is not None else None, size, id_col, text_col), "texts")

    def alike(pairs: DataFrame, label: str) -> DataFrame:
        return materialize(confirm(pairs, texts, percent, size), label)

    stars = materialize(held.where("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    one = stars.groupBy("b").agg(F.min("a").alias("a"))
    links = alike(one.select("a", "b"), "links")
    links = links if ties is None else links.unionByName(ties)
    found = components(links)
    rest = _apart(stars.join(one, ["a", "b"], "left_anti"), found)
    more = alike(rest, "links")
    links = links.unionByName(more)
    found = components(links)

    open_ = materialize(_open_tables(held, found), "open")
    if not open_.isEmpty():
        own = _own_shingles(texts.join(open_.select("rep").distinct(), "rep", "left_semi"), size)
        able = open_.join(own, "rep").where(100 * (F.col("n") - F.col("own")) >= percent * F.col("n"))
        able = materialize(_mixed(able), "able")
        central = able.groupBy("key").agg(F.min_by(F.struct("rep", "n", "own", "component"), F.struct(F.col("own") / F.col("n"), "rep")).alias("c"))
        pairs = able.join(central, "key").where((F.col("component") != F.col("c.component")) & _may_link("n", "own", "c.n", "c.own", percent))
        pairs = pairs.select(F.least("rep", "c.rep").alias("a"), F.greatest("rep", "c.rep").alias("b")).distinct()
        tested = materialize(stars.unionByName(pairs).distinct(), "tested")
        links = links.unionByName(alike(tested.join(stars, ["a", "b"], "left_anti"), "links"))
        found = components(links)

        halves = materialize(classes.select("rep", "halves").join(able.select("rep").distinct(), "rep", "left_semi"), "halves")
        able = materialize(_mixed(_relabel(able, found)).join(halves, "rep"), "apart")
        # Sets that are linked have sizes of the same or of neighbouring classes, which parts large tables.
        sized = able.withColumn("size", _size_class("n", percent))
        near = F.explode(F.array(*(F.col("size") + i for i in (-1, 0, 1))))
        left = sized.select("key", "size", *(F.col(c).alias(f"{c}_a") for c in ("rep", "n", "own", "component", "halves")))
        right = sized.select("key", near.alias("size"), *(F.col(c).alias(f"{c}_b") for c in ("rep", "n", "own", "component", "halves")))
        apart = (F.col("rep_a") < F.col("rep_b")) & (F.col("component_a") != F.col("component_b")) & _may_link("n_a", "own_a", "n_b", "own_b", percent)
        pairs = left.join(right, (left["key"] == right["key"]) & (left["size"] == right["size"]) & apart & (left["key"] == _first_key("halves_a", "halves_b", m)))
        pairs = pairs.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).join(tested, ["a", "b"], "left_anti")
        links = links.unionByName(alike(pairs, "links"))
        found = components(links)

    named = classes.select("set_id", "n_shingles", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("set_id", "n_shingles", F.coalesce("component", "rep").alias("component"))
    if ties is not None:  # classes are named by hashes there; the component is the smallest id of its rows
        named = materialize(named, "named")
        ids = worded.join(named, ["set_id", "n_shingles"]).groupBy("component").agg(F.min("doc_id").alias("least"))
        named = named.join(ids, "component").select("set_id", "n_shingles", F.col("least").alias("component"))
    # A class of many copies meets its component once for each salt, its rows are spread over the salts.
    rows = signed.where("n_shingles > 0").select("doc_id", "salt", "n_shingles", "set_id")
    spread = rows.groupBy("set_id", "n_shingles", "salt").agg(F.lit(1).alias("one")).join(named, ["set_id", "n_shingles"]).drop("one")
    out = rows.join(spread, ["set_id", "n_shingles", "salt"], "left").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = signed.where("n_shingles = 0 and doc_id is not null").select("doc_id", "n_shingles")
    # An id's row without words goes with its other rows.
    own = out.join(alone, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("own"))
    alone = alone.join(own, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("own", "doc_id").alias("component_id"))
    nameless = signed.where("n_shingles = 0 and doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return out.unionByName(alone).unionByName(nameless).select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", kept)


def _classes(worded: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(set_id, n_shingles, rep, halves) of the sets of equal shingles, and links (a, b) that tie the classes of one id.

    A class is named by its smallest id.  Where some id has several sets, that could name
    two classes alike; then hashes name them, and there are ties.
    """
    sets = worded.groupBy("set_id", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("halves").alias("halves"))
    several = worded.groupBy("doc_id").agg((F.min("set_id") != F.max("set_id")).alias("several")).where("several")
    if several.isEmpty():
        return materialize(sets, "classes"), None
    for seed in range(16):
        named = materialize(sets.withColumn("rep", F.xxhash64("set_id", "n_shingles", F.lit(seed))), "classes")
        if named.groupBy("rep").count().where("count > 1").isEmpty():
            break
        discard(named)
    else:
        raise ValueError("too many sets to tell them apart by 64 bits")
    own = worded.join(named.select("set_id", "n_shingles", "rep"), ["set_id", "n_shingles"]).select("doc_id", "rep").distinct()
    least = own.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("most")).where("a <> most")
    ties = own.join(least.select("doc_id", "a"), "doc_id").select("a", F.col("rep").alias("b")).where("a <> b").distinct()
    return named, materialize(ties, "ties")


def _texts_of(docs: DataFrame, reps: DataFrame, classes: DataFrame | None, size: int, id_col: str, text_col: str) -> DataFrame:
    """(rep, text): one text of each class in ``reps``; its smallest id's, or where hashes name classes, of any row of that set."""
    if classes is None:
        rows = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).where(F.col("text").rlike("[^ \\t-\\r]"))
        return rows.join(reps, "rep", "left_semi").groupBy("rep").agg(F.max("text").alias("text"))

    def run(batches):
        shingler = Shingler(size)
        for batch in batches:
            sets = [shingler.shingles(t) for t in batch["text"].to_pylist()]
            yield {"text": batch["text"], "n_shingles": [len(s) for s in sets], "set_id": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]}

    rows = map_columns(docs.where(F.col(id_col).isNotNull()).select(F.col(text_col).alias("text")), run, "text string, n_shingles long, set_id binary")
    return rows.join(classes.join(reps, "rep", "left_semi").select("set_id", "n_shingles", "rep"), ["set_id", "n_shingles"]).groupBy("rep").agg(F.max("text").alias("text"))


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    x = found.select(F.col("node").alias("a"), F.col("component").alias("x"))
    y = found.select(F.col("node").alias("b"), F.col("component").alias("y"))
    named = pairs.join(x, "a", "left").join(y, "b", "left")
    return named.where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")


def _relabel(held: DataFrame, found: DataFrame) -> DataFrame:
    named = held.drop("component").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    return named.withColumn("component", F.coalesce("component", "rep"))


def _open_tables(held: DataFrame, found: DataFrame) -> DataFrame:
    """(rep, n, key, component) of the tables that hold several components, and more classes than the pair already compared."""
    named = _relabel(held.select("rep", "n", "key"), found)
    mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("held"))
    return named.join(mixed.where("low <> high and held > 2").select("key"), "key", "left_semi")


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of the tables that hold several components."""
    mixed = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return rows.join(mixed.select("key"), "key", "left_semi")


def _size_class(n: str, percent: int) -> Column:
    """Classes so wide that sets whose sizes allow a link are at most one apart."""
    if percent >= 100:
        return F.col(n)
    return F.floor(F.log(F.col(n)) / (math.log(100 / percent) * (1 + 1e-9)))


def _may_link(n: str, own: str, other_n: str, other_own: str, percent: int) -> Column:
    """Whether the most that two sets can share suffices, and so does the least that they hold together."""
    shared = F.least(F.col(n) - F.col(own), F.col(other_n) - F.col(other_own))
    every = F.greatest(F.col(n) + F.col(other_own), F.col(other_n) + F.col(own))
    return 100 * shared >= percent * every


def _first_key(a: str, b: str, m: int) -> Column:
    """The key of the first table that holds both, by their hashes in either collection."""

    def first(start: int) -> Column:
        same = F.zip_with(F.slice(a, start, m), F.slice(b, start, m), lambda x, y: F.when(x == y, x))
        return F.get(F.filter(same, lambda x: x.isNotNull()), F.lit(0))

    return F.xxhash64(first(1), first(m + 1))


def _own_shingles(texts: DataFrame, size: int) -> DataFrame:
    """(rep, own): how many shingles of a class no other of these texts has."""

    def run(batches):
        shingler = Shingler(size)
        for batch in batches:
            yield pd.DataFrame({"rep": batch["rep"], "shingles": [shingler.shingles(t).view(np.int64) for t in batch["text"]]})

    rows = texts.select("rep", "text").mapInPandas(run, "rep long, shingles array<long>").select("rep", F.explode("shingles").alias("shingle"))
    single = rows.groupBy("shingle").agg(F.min("rep").alias("rep"), F.count("*").alias("held")).where("held = 1")
    counts = single.groupBy("rep").agg(F.count("*").alias("single"))
    return texts.select("rep").join(counts, "rep", "left").select("rep", F.coalesce("single", F.lit(0)).alias("own"))
