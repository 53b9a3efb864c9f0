"""License scans by canonical digest lookup (DataFrame functions only).

A text is reduced to a canonical form: copyright lines go, case folds, punctuation
becomes single spaces and equivalent spellings take one form.  The SHA-256 of that
form is joined with the digests of known license texts and notices: the notices below
and the whole texts in ``license_texts``.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import local_rows

# License notices and short license texts, as published.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    ),
]

# Headings that the whole texts of short licenses go under.
HEADINGS = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "The BSD 2-Clause License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "The BSD 3-Clause License"),
    "ISC": ("ISC License", "The ISC License"),
    "0BSD": ("Zero-Clause BSD", "BSD Zero Clause License", "Zero-Clause BSD License"),
}

# Spellings that count as the same word.
SPELLINGS = [
    ("licenc", "licens"),
    ("organis", "organiz"),
    ("favour", "favor"),
    ("non commercial", "noncommercial"),
    ("sub licens", "sublicens"),
    ("https", "http"),
]

COPYRIGHT = r"(?m)^[^\p{L}\p{N}]*(?:copyright\b|\(c\)|©)[^\n]*$"
SEPARATORS = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The canonical form; null stays null, a text of punctuation alone becomes empty."""
    low = F.lower(text)
    marked = low.contains("copyright") | low.contains("(c)") | low.contains("©")
    low = F.when(marked, F.regexp_replace(low, COPYRIGHT, " ")).otherwise(low)
    words = F.trim(F.regexp_replace(low, SEPARATORS, " "))
    for old, new in SPELLINGS:
        words = F.replace(words, F.lit(old), F.lit(new))
    return words


def whole_texts() -> list[tuple[str, str]]:
    """(license, text) of the whole texts as published; the short ones also unwrapped, and with or without a heading and their rights."""
    out = []
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        text, name = path.read_text(encoding="utf-8"), path.stem
        if name not in HEADINGS:
            out.append((name, text))
            continue
        for body in (text, re.sub(r"(?<!\n)\n(?!\n)", " ", text)):
            out += [(name, f"{h}\n{r}\n{body}") for h in ("", *HEADINGS[name]) for r in ("", "All rights reserved.")]
    return out


def catalogue(spark, known=None) -> DataFrame:
    """(digest, license, words) of the known texts (KNOWN and the whole texts if none are given), one row for each canonical form.

    ``words`` are the two longest words of the form that stand so in any text of that form:
    letters and digits that no spelling makes.
    """
    known = KNOWN + whole_texts() if known is None else known
    rows = local_rows(spark, [{"license": n, "known": t} for n, t in known], {"license": "string", "known": "string"})
    rows = rows.select("license", canonical(F.col("known")).alias("form"))
    made = [new for _, new in SPELLINGS]
    plain = F.filter(F.array_distinct(F.split("form", " ")), lambda w: ~F.exists(F.array(*map(F.lit, made)), lambda m: w.contains(m)))
    longest = F.reverse(F.array_sort(F.transform(plain, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))))
    words = F.transform(F.slice(longest, 1, 2), lambda x: x.w)
    return rows.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license").alias("license"), F.min(words).alias("words"))


def may_hold(text: Column, words: list[list[str]]) -> Column:
    """Whether the text holds all words of some known text, as every text of its form does."""
    every = F.lit(False)
    for pair in sorted({tuple(sorted(w)) for w in words}):
        held = F.lit(True)
        for w in sorted(pair, key=lambda w: (-len(w), w)):
            held = held & text.contains(w)
        every = every | held
    return every


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: bool = True, broadcast_rows: int = 100_000, most_pairs: int = 64) -> DataFrame:
    """Every license text or notice of the catalogue that a document is or holds as a line.

    A notice that is wrapped over lines, or a license text inside a longer text, is none.

    Returns (id, unit, line_no, license, digest): unit ``text`` with line 0 where the
    whole text is a known one, and, with ``lines``, unit ``line`` for each line of a
    text of several lines.  Null and empty texts have no rows, repeated rows are
    answered each, ids may be null, other columns are ignored.  Texts and lines that lack
    the words of every known text are left out before anything is reduced, if the
    catalogue has ``most_pairs`` different pairs of such words at most.  ``known`` is
    broadcast only up to ``broadcast_rows`` rows; beyond that Spark plans the join.
    """
    pairs = known.select(F.array_sort("words").alias("words")).distinct().limit(most_pairs + 1).collect() if "words" in known.columns else []
    narrow = 0 < len(pairs) <= most_pairs
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def able(body: Column) -> Column:
        # The text is lower-cased once, as the element that the words are looked for in.
        return F.exists(F.array(F.lower(body)), lambda low: may_hold(low, [r["words"] for r in pairs])) if narrow else F.lit(True)

    rows = rows.where(able(F.col("_text")))
    whole = rows.select("_id", F.lit("text").alias("unit"), F.lit(0).cast("long").alias("line_no"), F.col("_text").alias("body"))
    units = whole
    if lines:
        parts = F.split("_text", "\n", -1)
        own = rows.where(F.col("_text").contains("\n")).select("_id", F.posexplode(parts).alias("line_no", "body"))
        units = units.unionByName(own.select("_id", F.lit("line").alias("unit"), (F.col("line_no") + 1).cast("long").alias("line_no"), "body"))
    flat = units.where(able(F.col("body"))).select("_id", "unit", "line_no", canonical(F.col("body")).alias("form"))
    flat = flat.where(F.length("form") > 0).select("_id", "unit", "line_no", F.sha2("form", 256).alias("digest"))
    known = known.select("digest", "license")
    small = known.limit(broadcast_rows + 1).count() <= broadcast_rows
    found = flat.join(F.broadcast(known) if small else known, "digest")
    return found.select(F.col("_id").alias(id_col), "unit", "line_no", "license", "digest")
