"""Strongly connected components of any network, without a search on the driver.

Weak components that a task can hold are searched by one.  A larger one is cut into parts.  A task finds the components within its part and replaces the
part by them: by the ways between those where links enter and leave it, or by its own links
where these are fewer.  What is left is cut again as long as it shrinks, so that long chains,
circles and grids take a number of levels that grows with the logarithm of their size.  The
rest, whose ways are short, is taken apart by pivots: in every subproblem one is drawn by
hash and all are followed forwards and backwards at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut, drop
from .overlay import PART_LINKS, cut_parts
from .whole import WHOLE_LINKS, bins

#: A level must leave fewer links than this share.
SHRINK = 0.9


def search(n: int, tail: np.ndarray, head: np.ndarray) -> list[int]:
    """The component of each of ``n`` places, named by its smallest place; a depth-first search with a stack of its own."""
    order = np.argsort(tail, kind="stable")
    first = np.searchsorted(tail[order], np.arange(n + 1)).tolist()
    to = head[order].tolist()
    found, low, label, at = [-1] * n, [0] * n, [-1] * n, first[:]
    seen, waiting = 0, []
    for root in range(n):
        if found[root] >= 0:
            continue
        walk = [root]
        while walk:
            x = walk[-1]
            if found[x] < 0:
                found[x] = low[x] = seen
                seen += 1
                waiting.append(x)
            while at[x] < first[x + 1]:
                y = to[at[x]]
                if found[y] < 0:
                    walk.append(y)
                    break
                if label[y] < 0:
                    low[x] = min(low[x], low[y])
                at[x] += 1
            else:
                walk.pop()
                if low[x] == found[x]:
                    part = []
                    while not part or part[-1] != x:
                        part.append(waiting.pop())
                    least = min(part)
                    for y in part:
                        label[y] = least
    return label


class _Part:
    """A part's nodes in order and its links as places."""

    def __init__(self, nodes: pd.DataFrame, links: pd.DataFrame):
        self.names = np.sort(nodes["node"].to_numpy(np.int64))
        self.tail, self.head = (np.searchsorted(self.names, links[c].to_numpy(np.int64)) for c in ("u", "v"))

    def places(self, nodes) -> np.ndarray:
        return np.searchsorted(self.names, np.asarray(nodes, np.int64))

    def labels(self, extra: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        tail, head = (self.tail, self.head) if extra is None else (np.r_[a, b] for a, b in zip((self.tail, self.head), extra))
        return np.array(search(len(self.names), tail, head), np.int64)


def _ways(part: _Part, label: np.ndarray, entries: np.ndarray, exits: np.ndarray) -> set[tuple[int, int]]:
    """Links between components that keep who reaches whom: from entries to exits, or the part's own if those are fewer."""
    own = {(a, b) for a, b in zip(label[part.tail].tolist(), label[part.head].tolist()) if a != b}
    out: dict[int, list[int]] = {}
    for a, b in own:
        out.setdefault(a, []).append(b)
    ends, ways = set(label[exits].tolist()), set()
    for start in set(label[entries].tolist()):
        seen, todo = {start}, [start]
        while todo:
            for y in out.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        ways.update((start, x) for x in seen & ends if x != start)
        if len(ways) > len(own):
            return own
    return ways


def _within(nodes: DataFrame, inner: DataFrame) -> DataFrame:
    """(kind, a, b): of each part its nodes' components (0) and the links that stand for it (1).

    ``nodes`` is (part, node, entry, exit), ``inner`` (part, u, v).
    """

    def run(own, links):
        part = _Part(own, links)
        label = part.labels()
        at = part.places(own["node"])
        ways = sorted(_ways(part, label, at[own["entry"].to_numpy(bool)], at[own["exit"].to_numpy(bool)]))
        a, b = np.array(ways, np.int64).reshape(-1, 2).T
        named = pd.DataFrame({"kind": 0, "a": part.names, "b": part.names[label]})
        return pd.concat([named, pd.DataFrame({"kind": 1, "a": part.names[a], "b": part.names[b]})])

    return nodes.groupBy("part").cogroup(inner.groupBy("part")).applyInPandas(run, "kind int, a long, b long")


def _expanded(nodes: DataFrame, inner: DataFrame) -> DataFrame:
    """(node, component) of all nodes from the components of those that the level above knows.

    ``nodes`` is (part, node, component, known): what a node is above, where that is known.
    Nodes of one component above reach each other somehow, so a circle through them stands
    for the rest of the network.
    """

    def run(own, links):
        part = _Part(own, links)
        known = own[own["known"]].sort_values(["component", "node"])
        at, name = part.places(known["node"]), known["component"].to_numpy()
        if len(at):
            start = np.r_[True, name[1:] != name[:-1]]
            first = np.flatnonzero(start)
            last = np.r_[first[1:], len(at)] - 1
            after = np.r_[np.arange(1, len(at)), 0]
            after[last] = first
            label = part.labels((at, at[after]))
        else:
            label = part.labels()
        names = dict(zip(label[at].tolist(), name.tolist()))
        return pd.DataFrame({"node": part.names, "component": [int(names.get(x, part.names[x])) for x in label.tolist()]})

    return nodes.groupBy("part").cogroup(inner.groupBy("part")).applyInPandas(run, "node long, component long")


def _solved(pairs: DataFrame, part_links: int, levels: list | None) -> DataFrame:
    """(node, component) of the ends of distinct ``pairs`` (u, v) without loops, each named by one of its nodes."""
    parts = cut(cut_parts(pairs, part_links))
    of = lambda c: parts.select(F.col("node").alias(c), F.col("part").alias(f"p{c}"))
    tagged = cut(pairs.join(of("u"), "u").join(of("v"), "v"))
    inner = tagged.where("pu = pv").select(F.col("pu").alias("part"), "u", "v")
    cross = tagged.where("pu <> pv").select("u", "v")
    mark = lambda c, name: cross.select(F.col(c).alias("node")).distinct().withColumn(name, F.lit(True))
    nodes = parts.join(mark("v", "entry"), "node", "left").join(mark("u", "exit"), "node", "left")
    nodes = nodes.select("part", "node", F.coalesce("entry", F.lit(False)).alias("entry"), F.coalesce("exit", F.lit(False)).alias("exit"))
    within = cut(_within(nodes, inner))
    local = within.where("kind = 0").select(F.col("a").alias("node"), F.col("b").alias("local"))
    if levels is not None:
        levels.append(pairs.count())
    if cross.isEmpty():
        return local.select("node", F.col("local").alias("component"))
    named = lambda c: local.select(F.col("node").alias(c), F.col("local").alias(f"l{c}"))
    outer = cross.join(named("u"), "u").join(named("v"), "v").select(F.col("lu").alias("u"), F.col("lv").alias("v"))
    above = cut(outer.unionByName(within.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v"))).where("u <> v").distinct())
    if above.count() < SHRINK * tagged.count():
        found = _solved(above, part_links, levels)
    else:
        found = by_pivots(above, levels)
    # A node where links only enter, or only leave, has no ways the other way round above; alone there, it may not be so.
    several = found.groupBy("component").count().where("count > 1").select("component")
    known = found.join(several, "component").select(F.col("node").alias("local"), "component")
    placed = parts.join(local, "node").join(known, "local", "left").select("part", "node", F.coalesce("component", "local").alias("component"), F.col("component").isNotNull().alias("known"))
    out = cut(_expanded(placed, inner))
    drop(tagged, within, above)
    return out


def by_pivots(pairs: DataFrame, levels: list | None = None) -> DataFrame:
    """(node, component) of the ends of distinct ``pairs``: forward-backward search from a pivot in each subproblem.

    Nodes that a pivot reaches and that reach it are a component; the others part into those
    it reaches, those that reach it and the rest, which share no component and go on side by
    side.  Nodes without a link into or out of their subproblem are components of their own.
    """
    ends = lambda links: links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    nodes = cut(ends(pairs).withColumn("sub", F.lit(0).cast("long")))
    links = cut(pairs.select("u", "v"))
    done: list[DataFrame] = []
    k = 0
    while not nodes.isEmpty():
        k += 1
        core = nodes.join(links.select(F.col("u").alias("node")).distinct(), "node", "left_semi").join(links.select(F.col("v").alias("node")).distinct(), "node", "left_semi")
        core = cut(core)
        done.append(cut(nodes.join(core, "node", "left_anti").select("node", F.col("node").alias("component"))))
        pivot = core.groupBy("sub").agg(F.min_by("node", F.xxhash64("node", F.lit(k))).alias("node"))
        # Of a core a link may still lead to what has gone; those links are out of the search.
        inside = core.select("node", "sub")
        open_ = cut(links.join(inside.select(F.col("node").alias("u")), "u", "left_semi").join(inside.select(F.col("node").alias("v")), "v", "left_semi"))
        marks = cut(pivot.select("node", F.explode(F.array(F.lit(True), F.lit(False))).alias("forward")))
        frontier, tables = marks, [marks]
        while not frontier.isEmpty():
            ahead = frontier.where("forward").select(F.col("node").alias("u")).join(open_, "u").select(F.col("v").alias("node"), F.lit(True).alias("forward"))
            back = frontier.where("not forward").select(F.col("node").alias("v")).join(open_, "v").select(F.col("u").alias("node"), F.lit(False).alias("forward"))
            seen = tables[0]
            for t in tables[1:]:
                seen = seen.unionByName(t)
            frontier = cut(ahead.unionByName(back).distinct().join(seen, ["node", "forward"], "left_anti"))
            tables.append(frontier)
            if levels is not None:
                levels.append(-k)
        every = tables[0]
        for t in tables[1:]:
            every = every.unionByName(t)
        sides = every.groupBy("node").agg(F.max("forward").alias("f"), F.max(~F.col("forward")).alias("b"))
        split = cut(inside.join(sides, "node", "left").select("node", "sub", F.coalesce("f", F.lit(False)).alias("f"), F.coalesce("b", F.lit(False)).alias("b")))
        both = split.where("f and b")
        done.append(cut(both.join(both.groupBy("sub").agg(F.min("node").alias("component")), "sub").select("node", "component")))
        left = cut(split.where("not (f and b)").select("node", F.xxhash64("sub", "f", "b").alias("sub")))
        a, b = (left.select(F.col("node").alias(c), F.col("sub").alias(f"s{c}")) for c in ("u", "v"))
        rest = cut(open_.join(a, "u").join(b, "v").where("su = sv").select("u", "v"))
        drop(nodes, links, core, open_, split, *tables)
        nodes, links = left, rest
    out = done[0] if done else nodes.select("node", F.col("node").alias("component"))
    for part in done[1:]:
        out = out.unionByName(part)
    return cut(out)


def _in_tasks(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(node, component) of the ends of ``pairs`` in the weak components that ``held`` (node, bin) puts into tasks."""

    def run(links: pa.Table) -> pa.Table:
        names, ends = np.unique(np.concatenate([links["u"].to_numpy(), links["v"].to_numpy()]), return_inverse=True)
        label = search(len(names), *np.split(ends, 2))
        return pa.table({"node": names, "component": names[np.array(label, np.int64)]})

    tasks = (held.agg(F.max("bin")).first()[0] or 0) + 1
    dealt = pairs.join(held.withColumnRenamed("node", "u"), "u").select("bin", "u", "v").repartition(tasks, "bin")
    return dealt.groupBy("bin").applyInArrow(run, "node long, component long")


def strong_components(links: DataFrame, part_links: int | None = None, levels: list | None = None) -> DataFrame:
    """(node, component): strongly connected components of ``links`` (u, v), each named by its smallest node.

    Weak components of up to ``part_links`` links (WHOLE_LINKS without it) are searched by one
    task, larger ones in parts of about so many (PART_LINKS without it).  ``levels`` gets the
    number of links of each level of parts and the negative number of each search by pivots, once
    a round.  Repeated links and loops change nothing; an empty table gives no rows.
    """
    pairs = cut(links.select("u", "v").where("u <> v").distinct())
    nodes = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    if pairs.isEmpty():
        return nodes.select("node", F.col("node").alias("component"))
    held = bins(pairs, WHOLE_LINKS if part_links is None else part_links)
    found = _in_tasks(pairs, held.where("bin is not null"))
    over = held.where("bin is null")
    if not over.isEmpty():
        rest = cut(pairs.join(over.select(F.col("node").alias("u")), "u", "left_semi"))
        found = found.unionByName(_solved(rest, PART_LINKS if part_links is None else part_links, levels))
    found = cut(nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    drop(pairs, held)
    least = found.groupBy("component").agg(F.min("node").alias("_least"))
    return found.join(least, "component").select("node", F.col("_least").alias("component"))
