"""URL filters by rules indexed under their rarest literal token (DataFrame functions only).

A rule is a regular expression over ``host + path`` with the literal tokens that every
match holds as whole tokens.  The rule is filed under the one of them that the fewest
URLs of the input have; a URL's tokens fetch the rules filed under them, and only those
run.  Rules without such a token run on every URL.

Rules are written as filter lists commonly are: ``||host^path`` for a host and its
subdomains, ``|`` for either end, ``*`` for anything, ``^`` for a separator, ``/.../`` for
a regular expression and ``@@`` before an exception; other text stands anywhere.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, local_rows

TOKEN_SPLIT = "[^A-Za-z0-9]+"
HOST = r"^(?:[^/]*\.)?"


@dataclass(frozen=True)
class Rule:
    """``listed`` rules answer before all others, the longest ``name`` first; an exception outdoes what it excepts."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    listed: bool
    exception: bool = False


def listed(host: str, path: str, action: str) -> Rule:
    """A rule for a host, its subdomains and the paths that start with ``path``."""
    whole = re.split(TOKEN_SPLIT, host) + re.split(TOKEN_SPLIT, path)[:-1]  # the last token of a path may go on
    return Rule(host + path, action, HOST + re.escape(host) + re.escape(path), tuple(t for t in whole if t), True)


def label(word: str, action: str = "block") -> Rule:
    """A rule for hosts with the label ``word``, which may hold hyphens."""
    return Rule(word, action, HOST + re.escape(word) + r"(?:\.|/|$)", tuple(t for t in re.split(TOKEN_SPLIT, word) if t), False)


def host_word(word: str, action: str = "block") -> Rule:
    """A rule for hosts that have ``word`` between dots and hyphens."""
    return Rule(word, action, r"^(?:[^/]*[.-])?" + re.escape(word) + r"(?:[.-][^/]*)?(?:/|$)", (word,), False)


def parse(line: str) -> Rule | None:
    """The rule of a line of a filter list; blank lines, comments (``!``) and headings (``[``) are none."""
    name = line.strip()
    if not name or name[0] in "![":
        return None
    exception = name.startswith("@@")
    body = name[2:] if exception else name
    action = "allow" if exception else "block"
    if len(body) > 2 and body[0] == body[-1] == "/":
        re.compile(body[1:-1])
        return Rule(name, action, body[1:-1], (), False, exception)
    if "$" in body:
        raise ValueError(f"options are not understood: {line}")
    start = HOST if body.startswith("||") else "^" if body.startswith("|") else ""
    body = body.lstrip("|") if start else body
    end = "$" if body.endswith("|") else ""
    body = body.removesuffix("|")
    if start == HOST:  # hosts are compared in lower case
        at = re.search(r"[/^*]|\Z", body).start()
        body = body[:at].lower() + body[at:]
    parts = [{"*": ".*", "^": "(?:[^A-Za-z0-9_.%-]|$)"}.get(c) or re.escape(c) for c in body]
    tokens = []
    for m in re.finditer("[A-Za-z0-9]+", body):
        before = body[m.start() - 1] if m.start() else "|" if start else "*"
        after = body[m.end()] if m.end() < len(body) else "|" if end else "*"
        if "*" not in (before, after):
            tokens.append(m[0])
    return Rule(name, action, start + "".join(parts) + end, tuple(tokens), False, exception)


def read_rules(spark: SparkSession, path: str, most: int = 1_000_000) -> list[Rule]:
    """The rules of a filter list, one to a line, of ``most`` lines at most."""
    lines = [r["value"] for r in spark.read.text(path).limit(most + 1).collect()]
    if len(lines) > most:
        raise ValueError(f"over {most} lines in {path}")
    return [r for r in map(parse, lines) if r]


# Labels and words of hosts that corpora leave out, and paths that hold no prose.
LABELS = ["spam-farm", "adult-x", "casino-win", "phish-login"]
HOST_WORDS = (
    "porn porno xxx sex escort escorts camgirls hentai nsfw casino casinos poker roulette betting gambling jackpot bingo sportsbook "
    "viagra cialis pharma payday warez keygen cracked torrents phishing bet bets loans pills malware spyware ransomware botnet clickbait spam"
).split()
LIST = """
! pages that ask for a login, pay or report rather than say something
*/wp-login.php
*/xmlrpc.php
*/phpmyadmin/*
*/cgi-bin/*
*/wp-admin/*
*/account/verify/*
*/checkout/cart/*
*/signin/confirm/*
@@||wikipedia.org^
@@||archive.org^
"""

RULES = [
    listed("net", "/", "block"),
    listed("example.net", "/en/", "allow"),
    listed("example.com", "/de/", "block"),
    listed("org", "/fr/", "allow"),
    *map(label, LABELS),
    *map(host_word, HOST_WORDS),
    *filter(None, map(parse, LIST.split("\n"))),
]


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: list[Rule] = RULES, id_col: str = "page_id", url_col: str = "url", block_rules: int = 10_000) -> DataFrame:
    """(id, host, path, rule, verdict, pattern_rule) of every row.

    ``rule`` is the longest listed rule that fits, with its action as the verdict.
    Else the longest other rule that fits decides (``pattern_rule``), exceptions before
    all others, and a URL that no rule fits is allowed.  A null URL and one without
    ``://`` have an empty host and path and are allowed; ids may be null; repeated rows
    are answered each; an empty table gives none; other columns are ignored.  Rules are
    taken in blocks of ``block_rules``, which bounds what is broadcast at once.
    """
    spark = pages.sparkSession
    url = F.col("_url")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    keyed = rows.where(url.isNotNull()).select("_url", F.concat(host_of(url), path_of(url)).alias("_key"))
    tokens = keyed.select("_url", "_key", F.explode(F.array_distinct(F.split("_key", TOKEN_SPLIT, -1))).alias("token"))

    parts = [rules[at : at + block_rules] for at in range(0, len(rules), block_rules)]
    found = None
    for part in parts:
        literal = local_rows(spark, [{"token": t} for t in sorted({t for r in part for t in r.tokens})], {"token": "string"})
        counts = dict(tokens.join(F.broadcast(literal), "token", "left_semi").groupBy("token").count().collect())  # bounded by the rules
        filed = [
            {"token": min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), "name": r.name, "action": r.action, "pattern": r.pattern, "listed": r.listed, "exception": r.exception}
            for r in part
            if not r.tokens or all(counts.get(t) for t in r.tokens)  # else no URL holds all of its tokens
        ]
        table = local_rows(spark, filed, {"token": "string", "name": "string", "action": "string", "pattern": "string", "listed": "boolean", "exception": "boolean"})
        fetched = tokens.where("token <> ''")
        if any(not r["token"] for r in filed):
            fetched = fetched.unionByName(keyed.select("_url", "_key", F.lit("").alias("token")))
        fits = fetched.join(F.broadcast(table), "token").where(F.expr("_key rlike pattern")).drop("_key", "token", "pattern")
        found = fits if found is None else found.unionByName(fits)
    best = _best(found) if found is not None else rows.limit(0).select("_url", F.lit(None).cast(ANSWER).alias("own"), F.lit(None).cast(ANSWER).alias("other"))
    # Null URLs fit no rule and stay out of the join, where they would be one key.
    answered = rows.where(url.isNotNull()).join(best, "_url", "left")
    unknown = rows.where(url.isNull()).select("_url", "_id", F.lit(None).cast(ANSWER).alias("own"), F.lit(None).cast(ANSWER).alias("other"))
    return answered.unionByName(unknown).select(
        F.col("_id").alias(id_col),
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        F.col("own.name").alias("rule"),
        F.coalesce("own.action", "other.action", F.lit("allow")).alias("verdict"),
        F.col("other.name").alias("pattern_rule"),
    )


ANSWER = "struct<exception: boolean, n: int, name: string, action: string>"


def _best(fits: DataFrame) -> DataFrame:
    """(_url, own, other): the listed rule and the other rule that answer; only URLs that some rule fits are shuffled."""
    order = F.struct("exception", F.length("name").alias("n"), "name", "action")
    return fits.groupBy("_url").agg(F.max(F.when(F.col("listed"), order)).alias("own"), F.max(F.when(~F.col("listed"), order)).alias("other"))
