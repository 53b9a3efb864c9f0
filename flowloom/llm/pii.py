"""Personal data by weak supervision.

Exact patterns find e-mail addresses, IP addresses, payment cards and phone numbers; these
base spans always stay, and so do bank account numbers (IBAN) whose check digits hold.
Further candidates are credentials (runs of letters, digits and their usual punctuation)
and personal names (neighbouring capitalised words).  For each of the two kinds labelers
vote: a regex of published formats, a gazetteer, the context around the candidate and its
shape, each on evidence of its own.  Expectation-maximisation estimates how reliable each
labeler is from their agreement alone; its beliefs train a logistic span classifier for
the kind, which decides.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_name, discard, map_columns, materialize

KINDS = ("email", "ip", "card", "phone", "iban", "secret", "name")
BASE = KINDS[:4]
LEARNT = KINDS[5:]
Span = tuple[str, int, int]

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can only start where a run of digits does: it takes whole runs, and fails for all of a run alike.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What may stand before is looked at after a match: patterns that begin with their first letters are found faster.
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
DIGIT = re.compile(r"[0-9]")
RUN_CHARS = LOCAL_CHARS - frozenset("%") | frozenset("/")
RUN = re.compile(r"[A-Za-z0-9_+/.-]+(?:={1,2}(?![A-Za-z0-9=]))?")
PERSON = re.compile(r"[A-Z][a-z]{1,20}(?: [A-Z]\.)?(?: [A-Z][a-z]{1,20}){1,2}(?!\w)")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> list[Span]:
    """The leftmost matches, found from each ``@`` so that long runs cost no more than their length."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[Span]:
    """The spans of the exact patterns, by start and kind."""
    out = emails(text)
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    if text.find(".") >= 0:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def iban_spans(text: str, taken: list[Span]) -> list[Span]:
    """Account numbers of 15 to 34 characters with right check digits, outside the base spans."""
    out = []
    for m in IBAN.finditer(text):
        if m.start() and text[m.start() - 1].isalnum():
            continue
        plain = m[0].replace(" ", "")
        if len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
            out.append(("iban", *m.span()))
    return apart(out, taken)


def apart(spans: list[Span], taken: list[Span]) -> list[Span]:
    """The spans that overlap none of ``taken``; both ascend by start."""
    out, at, reach = [], 0, -1
    for s in spans:
        while at < len(taken) and taken[at][1] < s[2]:
            reach = max(reach, taken[at][2])
            at += 1
        if reach <= s[1]:
            out.append(s)
    return out


# Published formats of keys, words that name credentials, titles and given names.
FORMATS = re.compile(
    r"AKIA[0-9A-Z]{16}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|gh[pousr]_[A-Za-z0-9]{36}|sk_(?:live|test)_[A-Za-z0-9]{24,}"
    r"|AIza[0-9A-Za-z_-]{35}|xox[abprs]-[0-9A-Za-z-]{10,}|glpat-[0-9A-Za-z_-]{20}|eyJ[0-9A-Za-z_-]+\.eyJ[0-9A-Za-z_-]+\.[0-9A-Za-z_-]+"
)
CREDENTIALS = frozenset("token password passwd pwd secret key apikey api_key auth bearer credential credentials access_key private_key client_secret passphrase".split())
TITLES = frozenset("mr mrs ms miss dr prof herr frau sr sra don m mme mlle".split())
GIVEN = frozenset(
    "james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen "
    "christopher nancy daniel lisa matthew betty anthony margaret mark sandra paul ashley steven kimberly andrew emily kenneth donna joshua michelle "
    "kevin carol brian amanda george melissa edward deborah hans peter klaus maria anna ursula monika petra sabine jose antonio juan manuel francisco "
    "luis carmen josefa isabel dolores jean pierre michel andre philippe marie jeanne francoise monique catherine nathalie".split()
)
BEFORE = re.compile(r"([A-Za-z_]+)?[\"']?\s*(:=|=>|[=:]?)\s*([\"']?)\Z")
WORDS = re.compile(r"[A-Za-z][a-z]{3,}|[A-Z]{4,}")
TITLE = re.compile(r"(\w+)\.?\s*\Z")
OPENING = re.compile(r"(?:\A|[.!?:\n\"'(])\s*\Z")
LABELERS = ("format", "gazetteer", "context", "shape")
SHORT = 16


def _before(text: str, start: int) -> tuple[str, str, str]:
    """(word, sign, quote) just before a candidate."""
    m = BEFORE.search(text, max(0, start - 40), start)
    return (m[1] or "").lower(), m[2], m[3]


def secret_candidates(text: str, taken: list[Span]) -> list[Span]:
    """Runs with a letter and a digit outside ``taken``; runs under SHORT characters only after the name of a credential."""
    out, free = [], 0
    while digit := DIGIT.search(text, free):
        start = digit.start()
        while start > free and text[start - 1] in RUN_CHARS:
            start -= 1
        free = RUN.match(text, start).end()
        run = text[start:free]
        start += len(run) - len(run.lstrip("+/.-"))
        end = free - (len(run) - len(run.rstrip("+/.-")))
        run = text[start:end]
        if len(run) < 8 or not any(map(str.isalpha, run)):
            continue
        if len(run) >= SHORT or _before(text, start)[0] in CREDENTIALS:
            out.append(("secret", start, end))
    return apart(out, taken)


def secret_votes(text: str, start: int, end: int) -> list[int]:
    """Of each labeler: 1 for a credential, 0 against it, -1 for no opinion."""
    run = text[start:end]
    word, sign, quote = _before(text, start)
    plain = sum(map(len, WORDS.findall(run))) / len(run)
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(run, run[1:])) / len(run)
    return [
        1 if FORMATS.fullmatch(run) else 0 if plain >= 0.5 else -1,
        1 if word in CREDENTIALS else -1 if not word else 0,
        0 if text[max(0, start - 2) : start] == "//" or text[start - 1 : start] in "@#/?&" and start else 1 if sign or quote else -1,
        1 if changes >= 0.15 else 0,
    ]


def secret_features(text: str, start: int, end: int) -> list[float]:
    """The run's length, digit share, case, variety of characters and share of words."""
    run = text[start:end]
    n = len(run)
    return [math.log2(n) / 8, sum(map(str.isdigit, run)) / n, sum(map(str.isupper, run)) / n, len(set(run)) / min(n, 62), sum(map(len, WORDS.findall(run))) / n]


def name_candidates(text: str, taken: list[Span]) -> list[Span]:
    """Two or three neighbouring capitalised words, with an initial perhaps, outside ``taken``."""
    found = (m.span() for m in PERSON.finditer(text))
    return apart([("name", a, b) for a, b in found if not a or not (text[a - 1].isalnum() or text[a - 1] == "_")], taken)


def name_votes(text: str, start: int, end: int) -> list[int]:
    """Of each labeler: 1 for a personal name, 0 against it, -1 for no opinion."""
    words = text[start:end].split()
    m = TITLE.search(text, max(0, start - 20), start)
    titled = bool(m) and m[1].lower() in TITLES
    return [
        1 if any(len(w) == 2 and w[1] == "." for w in words) else -1,
        1 if words[0].lower() in GIVEN else 0,
        1 if titled else 0 if OPENING.search(text, max(0, start - 5), start) else -1,
        0 if any(w.lower() in between_spaces(text) for w in words) else -1,
    ]


@lru_cache(maxsize=1)
def between_spaces(text: str) -> frozenset[str]:
    """What stands between two spaces of a text, found once for all of its candidates."""
    return frozenset(text.split(" ")[1:-1])


def name_features(text: str, start: int, end: int) -> list[float]:
    """The candidate's words, its length and the longest word."""
    words = text[start:end].split()
    return [len(words) / 4, (end - start) / 40, max(map(len, words)) / 20, 1.0 if "-" in text[start:end] else 0.0, 0.0]


OF_KIND = {"secret": (secret_candidates, secret_votes, secret_features), "name": (name_candidates, name_votes, name_features)}
N_FEATURES = 1 + len(LABELERS) + 5


def candidates(text: str, taken: list[Span]) -> list[Span]:
    """The candidates of all learnt kinds outside ``taken``, which ascends by start."""
    return [c for kind in LEARNT for c in OF_KIND[kind][0](text, taken)]


def judged(text: str, span: Span) -> tuple[list[int], list[float]]:
    """(votes, features) of a candidate; the votes are features too."""
    kind, start, end = span
    votes = OF_KIND[kind][1](text, start, end)
    return votes, [1.0, *[(x == 1) - (x == 0) + 0.0 for x in votes], *OF_KIND[kind][2](text, start, end)]


def estimate(votes_: np.ndarray, rounds: int = 50, prior: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Beliefs in each candidate and each labeler's (hit rate, false alarm rate), by expectation-maximisation.

    Labelers vote 1, 0 or -1 (no opinion).  Beliefs start from the share of votes for.
    """
    yes, no = votes_ == 1, votes_ == 0
    belief = (yes.sum(1) + prior) / (yes.sum(1) + no.sum(1) + 1)
    rates = np.full((votes_.shape[1], 2), 0.5)
    for _ in range(rounds):
        share = np.clip(belief.mean() if len(belief) else prior, 0.01, 0.99)
        for side, weight in enumerate((belief, 1 - belief)):
            rates[:, side] = np.clip(((yes * weight[:, None]).sum(0) + 1 - side * 0.5) / (((yes | no) * weight[:, None]).sum(0) + 1.5), 0.02, 0.98)
        logit = math.log(share / (1 - share)) + (yes * np.log(rates[:, 0] / rates[:, 1]) + no * np.log((1 - rates[:, 0]) / (1 - rates[:, 1]))).sum(1)
        belief = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return belief, rates


@dataclass(frozen=True)
class Classifier:
    """A kind's span classifier: its weights, and the labelers' estimated (hit rate, false alarm rate)."""

    weights: tuple[float, ...]
    rates: tuple[tuple[float, float], ...]

    def accepts(self, row: list[float]) -> bool:
        return sum(w * x for w, x in zip(self.weights, row)) > 0


Model = dict[str, Classifier]


def train(rows: np.ndarray, votes_: np.ndarray, steps: int = 400, rate: float = 0.5, decay: float = 1e-3) -> Classifier:
    """Fit the classifier to the beliefs; without candidates it accepts what most labelers would."""
    if not len(rows):
        return Classifier((-0.5, *[1.0] * len(LABELERS), *[0.0] * (N_FEATURES - 1 - len(LABELERS))), tuple((0.5, 0.5) for _ in LABELERS))
    belief, rates = estimate(votes_)
    w = np.zeros(rows.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-rows @ w))
        w -= rate * (rows.T @ (p - belief) / len(rows) + decay * w)
    return Classifier(tuple(w.tolist()), tuple(map(tuple, rates.tolist())))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 5_000) -> Model:
    """Train on at most ``sample`` candidates of each kind: those of the smallest hash of text and place.

    Those of equal texts count once.  Only candidates under a hash bound that follows from
    their number meet: about ``sample`` and six standard deviations more.  Null ids teach like
    others; an empty table gives classifiers that follow most labelers.
    """

    def gather(batches):
        for batch in batches:
            out = []
            for key, text in zip(batch["_key"], batch["_text"]):
                for span in candidates(text, fixed_spans(text)[1]):
                    out.append((span[0], key, span[1], *judged(text, span)))
            yield pd.DataFrame(out, columns=["kind", "key", "at", "votes", "features"])

    rows = docs.select(F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("_text")).where("_text is not null")
    found = rows.mapInPandas(gather, "kind string, key long, at long, votes array<int>, features array<double>")
    found = materialize(found, "candidates")
    out, bound = {}, sample + 6 * math.sqrt(sample)
    counts = {r["kind"]: r["n"] for r in found.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    place = F.xxhash64("key", "at")
    for kind in LEARNT:
        few = found.where((F.col("kind") == kind) & (place / 2.0**64 + 0.5 < bound / max(1, counts.get(kind, 0)))).dropDuplicates(["key", "at"])
        held = few.orderBy(place, "key", "at").limit(sample).collect()
        out[kind] = train(np.array([r["features"] for r in held], float), np.array([r["votes"] for r in held], int).reshape(len(held), len(LABELERS)))
    discard(found)
    return out


def _order(span: Span) -> tuple[int, int]:
    return span[1], KINDS.index(span[0])


def fixed_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, base spans and account numbers), by start and kind."""
    base = base_spans(text)
    more = iban_spans(text, base)
    return base, sorted(base + more, key=_order) if more else base


def spans_of(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), by start and kind."""
    base, fixed = fixed_spans(text)
    more = [c for c in candidates(text, fixed) if model[c[0]].accepts(judged(text, c)[1])]
    return base, sorted(fixed + more, key=_order) if more else fixed


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_iban long, n_secret long, n_name long"


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and spans of every text, one row for each row, no shuffle.

    The counts by kind are of all spans, ``base_sha256`` is of the base spans, ``spans``
    lists all of them (code points, end exclusive).  A null text counts as empty and has
    no span; ids may be null; repeated rows are answered each.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [c.split()[0] for c in FOUND.split(", ")]

    def run(batches):
        for batch in batches:
            out = []
            for text in batch["_text"].to_pylist():
                base, found = spans_of(text or "", model)
                n = [sum(k == s[0] for s in found) for k in KINDS]
                out.append((*n[:4], hashlib.sha256(written(base).encode()).hexdigest(), written(found), *n[4:]))
            yield {"_id": batch["_id"]} | by_name(out, names)

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return map_columns(rows, run, f"_id {kind}, {FOUND}").withColumnRenamed("_id", id_col)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its texts replaced; null texts stay null, all other columns stay."""

    def run(batches):
        for batch in batches:
            texts = [t if t is None else redacted(t, spans_of(t, model)[1]) for t in batch[text_col].to_pylist()]
            yield batch.set_column(batch.schema.get_field_index(text_col), text_col, pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)
