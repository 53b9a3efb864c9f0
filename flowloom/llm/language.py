"""Language identification with word-first backoff.

Known words are scored by their log frequency in each language.  An unseen word falls
back to its character n-grams: the longest order of which some n-gram is known scores it.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_columns, materialize

WORD = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)
UNDETERMINED = "und"
#: Languages up to which their numbers of rows are broadcast.
MANY = 10_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams(word: str, order: int) -> list[str]:
    marked = f"\x02{word}\x03"
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


class Model:
    """Log frequencies of words and n-grams by language, all of bounded number; ``counts`` are by order (0: words) and language."""

    def __init__(self, counts: dict[int, dict[str, Counter]]):
        self.languages = sorted(counts.get(0, {}))
        self.tables: list[dict[str, tuple[float, ...]]] = [self._logs({lang: counts.get(order, {}).get(lang, Counter()) for lang in self.languages}) for order in (0, *ORDERS)]

    def _logs(self, held: dict[str, Counter]) -> dict[str, tuple[float, ...]]:
        """Log frequencies by language relative to their mean, so that what is as frequent everywhere says nothing."""
        known = set().union(*held.values()) if held else set()
        sums = {lang: sum(c.values()) for lang, c in held.items()}
        out = {}
        for k in sorted(known):
            logs = [math.log((held[lang][k] + 0.5) / (sums[lang] + 0.5 * len(known))) for lang in self.languages]
            mean = sum(logs) / len(logs)
            out[k] = tuple(x - mean for x in logs)
        return out

    def score(self, word: str) -> tuple[float, ...]:
        """Of a known word its own scores, else the mean of its n-grams' of the longest order with a known one."""
        found = self.tables[0].get(word)
        if found is not None:
            return found
        for order, table in zip(ORDERS, self.tables[1:]):
            logs = [table[g] for g in grams(word, order) if g in table]
            if logs:
                return tuple(sum(x) / len(logs) for x in zip(*logs))
        return (0.0,) * len(self.languages)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, docs_per_language: int) -> DataFrame:
    """(_lang, _text) of the ``docs_per_language`` rows of the smallest hash of id and text of each language.

    Only rows under a hash bound that follows from the language's number of rows meet: about
    ``docs_per_language`` and six standard deviations more, whatever the table holds.
    """
    rows = docs.select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"), F.xxhash64(id_col, text_col).alias("_hash")).where("_lang is not null and _text is not null")
    bound = docs_per_language + 6 * math.sqrt(docs_per_language)
    counts = materialize(rows.groupBy("_lang").agg(F.count("*").alias("_n")), "languages")
    # Broadcast where there are few languages, so that no text is shuffled but those under the bound.
    counts = F.broadcast(counts) if counts.limit(MANY + 1).count() <= MANY else counts
    few = rows.join(counts, "_lang").where(F.col("_hash") / 2.0**64 + 0.5 < bound / F.col("_n")).dropDuplicates(["_lang", "_hash"])
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_hash"))
    return few.withColumn("_rank", rank).where(F.col("_rank") <= docs_per_language).select("_lang", "_text")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 1500, max_words: int = 20_000, max_grams: int = 6_000) -> Model:
    """Learn from at most ``docs_per_language`` labelled rows of each language.

    They are those of the smallest hash of id and text; equal rows count once.
    ``max_words`` words of a language and ``max_grams`` of its n-grams of each order are
    kept, the most frequent ones in the whole sample.  Rows without a language or a text
    teach nothing; an empty table gives a model without languages.
    """

    def count(batches):
        for batch in batches:
            found: dict[tuple[str, int], Counter] = {}
            for lang, text in zip(batch["_lang"], batch["_text"]):
                found.setdefault((lang, 0), Counter()).update(words_of(text))
            for (lang, _), words in list(found.items()):
                for order in ORDERS:
                    c = found[lang, order] = Counter()
                    for word, n in words.items():
                        for g in grams(word, order):
                            c[g] += n
            yield pd.DataFrame([(lang, order, w, n) for (lang, order), c in found.items() for w, n in c.items()], columns=["lang", "order", "gram", "n"])

    held = sample(docs, id_col, text_col, lang_col, docs_per_language)
    totals = held.mapInPandas(count, "lang string, order int, gram string, n long").groupBy("lang", "order", "gram").agg(F.sum("n").alias("n"))
    best = F.row_number().over(Window.partitionBy("lang", "order").orderBy(F.desc("n"), "gram"))
    kept = totals.withColumn("_rank", best).where(F.col("_rank") <= F.when(F.col("order") == 0, max_words).otherwise(max_grams))
    counts: dict[int, dict[str, Counter]] = {}
    for lang, order, gram, n in kept.select("lang", "order", "gram", "n").toLocalIterator():
        counts.setdefault(order, {}).setdefault(lang, Counter())[gram] = n
    return Model(counts)


class Scorer:
    """Predicts texts; scores of words that were met are kept, up to ``keep`` of them."""

    def __init__(self, model: Model, keep: int = 300_000):
        self._model, self._keep = model, keep
        self._reset()

    def _reset(self) -> None:
        self._rows = np.zeros((1024, len(self._model.languages) + 1))
        self._at: dict[str, int] = {}

    def _add(self, word: str) -> None:
        n = len(self._at)
        if n == len(self._rows):
            self._rows = np.concatenate([self._rows, np.zeros_like(self._rows)])
        if any(map(str.isalpha, word)):
            self._rows[n, :-1] = self._model.score(word)
            self._rows[n, -1] = 1
        self._at[word] = n

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, share of belief): ``und`` and 0 for a text without a letter or a model without languages."""
        words = words_of(text or "")
        languages = self._model.languages
        if not words or not languages:
            return UNDETERMINED, 0.0
        if len(self._at) > self._keep:
            self._reset()
        at = self._at
        try:
            rows = list(map(at.__getitem__, words))
        except KeyError:
            for w in words:
                if w not in at:
                    self._add(w)
            rows = list(map(at.__getitem__, words))
        total = self._rows[rows].sum(axis=0)
        n = total[-1]
        if not n:
            return UNDETERMINED, 0.0
        belief = total[:-1] * min(1.0, 20 / n)  # words aren't independent: twenty count in full
        belief = np.exp(belief - belief.max())
        best = int(belief.argmax())
        return languages[best], float(belief[best] / belief.sum())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (id, the columns named in ``keep``) with lang_pred and score, one row for each row, no shuffle.

    The model's size is bounded by the parameters of :func:`fit`; it is broadcast.  Null
    and empty texts and those without a letter are ``und`` with 0; ids may be null;
    repeated rows are answered each; an empty table gives none.  A kept column named
    like a result gives way to it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = [c for c in dict.fromkeys([id_col, *keep]) if c not in ("lang_pred", "score")]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([f"`{c}` {types[c]}" for c in given] + ["lang_pred string", "score double"])

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer.predict(t) for t in batch[text_col].to_pylist()]
            yield {c: batch[c] for c in given} | {"lang_pred": [x for x, _ in found], "score": [float(s) for _, s in found]}

    return map_columns(docs.select(*dict.fromkeys([*given, text_col])), run, schema)


def identified(docs: DataFrame, model: Model, least: float, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is predicted with a score of ``least`` or more; that becomes ``lang_col``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer.predict(t) for t in batch[text_col].to_pylist()]
            named = batch.set_column(batch.schema.get_field_index(lang_col), lang_col, pa.array([x for x, _ in found], pa.string()))
            yield named.filter(pa.array([x != UNDETERMINED and s >= least for x, s in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
