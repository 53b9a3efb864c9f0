"""Shortest paths of any network over an overlay of its parts.

The network is cut into parts of bounded size.  Within a part one task finds the distances
from where ways enter it to where they leave it; these and the links between parts form an
overlay, over which labels move in distance buckets, a part a round instead of a link a
round.  Labels of a round are appended to those before.  A last search in each part, from
the labels at its entries, settles the nodes inside.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut, drop
from .paths import Adjacency

#: Links of a part, about: what one task holds and searches once for each way in.
PART_LINKS = 20_000
#: Sources whose labels meet a part in one task.
SOURCES = 256
#: Tables of appended labels after which they are written as one.
TABLES = 16


def cut_parts(links: DataFrame, part_links: int = PART_LINKS) -> DataFrame:
    """(node, part) of the ends of ``links`` (u, v): connected parts with about ``part_links`` outgoing links at most.

    In each round parts draw lots to stay or to move, and those that move join a neighbour
    that stays and has room; where more want to join than there is room for, a share of them
    by hash does.  Parts grow by a factor a round, so the rounds grow with the logarithm
    of ``part_links``.  A node with more links than that is a part of its own.
    """
    pairs = cut(links.select("u", "v").where("u <> v").distinct())
    weights = links.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("weight"))
    nodes = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    parts = cut(nodes.join(weights, "node", "left").select("node", F.col("node").alias("part"), (F.coalesce("weight", F.lit(0)) + 1).alias("weight")))
    if (parts.agg(F.sum("weight")).first()[0] or 0) <= part_links:
        return parts.select("node", F.lit(0).cast("long").alias("part"))
    idle, k = 0, 0
    while idle < 3 and k < 4 * part_links.bit_length():
        k += 1
        lot = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(k)), F.lit(2)) == 0  # noqa: B023, E731
        sizes = parts.groupBy("part").agg(F.sum("weight").alias("size")).where(F.col("size") < part_links)
        a, b = (parts.select(F.col("node").alias(c), F.col("part").alias(f"p{c}")) for c in ("u", "v"))
        met = pairs.join(a, "u").join(b, "v").where("pu <> pv").select("pu", "pv").distinct()
        met = met.unionByName(met.select(F.col("pv").alias("pu"), F.col("pu").alias("pv"))).where(~lot("pu") & lot("pv"))
        room = met.join(sizes.select(F.col("part").alias("pu"), F.col("size").alias("own")), "pu").join(sizes.select(F.col("part").alias("pv"), F.col("size").alias("held")), "pv")
        room = room.where(F.col("own") + F.col("held") <= part_links)
        wish = room.groupBy(F.col("pu").alias("part"), "own").agg(F.min(F.struct(F.xxhash64("pv", F.lit(k)).alias("h"), F.col("pv").alias("to"), "held")).alias("w"))
        wish = wish.select("part", "own", F.col("w.to").alias("to"), F.col("w.held").alias("held"))
        asked = wish.groupBy("to").agg(F.sum("own").alias("asked"))
        share = F.pmod(F.xxhash64("part", F.lit(-k)), F.lit(1_000_000)) / 1_000_000
        moves = cut(wish.join(asked, "to").where(F.col("asked") * share <= part_links - F.col("held")).select("part", "to"))
        idle = idle + 1 if moves.isEmpty() else 0
        moved = cut(parts.join(moves, "part", "left").select("node", F.coalesce("to", "part").alias("part"), "weight"))
        drop(parts, moves)
        parts = moved
    drop(pairs)
    return parts.select("node", "part")


def settle(graph: Adjacency, cost: list[float], starts: list[tuple[int, float, int | None]]) -> list[tuple[int, float, int | None]]:
    """(node, distance, parent link) of all nodes that ``starts``, such triples themselves, reach within a part."""
    nodes, head, first = graph.lists
    ids, names = graph.link_id.tolist(), graph.names.tolist()
    out, dist, parent, done, queue = [], {}, {}, set(), []
    for node, d, link in starts:
        i = nodes.get(node)
        if i is None:
            out.append((node, d, link))
        else:
            dist[i], parent[i] = d, link
            queue.append((d, i))
    heapq.heapify(queue)
    while queue:
        d, i = heapq.heappop(queue)
        if i in done:
            continue
        done.add(i)
        out.append((names[i], d, parent[i]))
        for k in range(first[i], first[i + 1]):
            j = head[k]
            if j in done:
                continue
            new, old = d + cost[k], dist.get(j)
            if old is None or new < old:
                dist[j], parent[j] = new, ids[k]
                heapq.heappush(queue, (new, j))
            elif new == old and parent[j] is not None and ids[k] < parent[j]:
                parent[j] = ids[k]
    return out


def _graph(links: pd.DataFrame) -> tuple[Adjacency, list[float]]:
    graph = Adjacency(links["link_id"].to_numpy(np.int64), links["u"].to_numpy(np.int64), links["v"].to_numpy(np.int64))
    return graph, links["cost"].to_numpy(float)[graph.order].tolist()


def _shortcuts(inner: DataFrame, marks: DataFrame) -> DataFrame:
    """(start, u, dist): the distances within each part from its starts to its exits; ``marks`` is (part, node, start, exit)."""

    def run(links, marked):
        graph, cost = _graph(links)
        leaving = marked.loc[marked["exit"], "node"].tolist()
        places = [(x, graph.nodes[x]) for x in leaving if x in graph.nodes]
        out = []
        for s in marked.loc[marked["start"], "node"].tolist():
            if s not in graph.nodes:
                out.extend((s, x, 0.0) for x in leaving if x == s)
                continue
            dist = graph.search(s, cost)[0]
            out.extend((s, x, dist[i]) for x, i in places if dist[i] < float("inf"))
        return pd.DataFrame(out, columns=["start", "u", "dist"])

    return inner.groupBy("part").cogroup(marks.groupBy("part")).applyInPandas(run, "start long, u long, dist double")


LABELS = "source long, node long, dist double, link_id long"


def _best(tables: list[DataFrame]) -> DataFrame:
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    best = every.groupBy("source", "node").agg(F.min(F.struct("dist", F.coalesce("link_id", F.lit(-(2**63))).alias("link"), "link_id", "seq")).alias("b"))
    return best.select("source", "node", F.col("b.dist").alias("dist"), F.col("b.link_id").alias("link_id"), F.col("b.seq").alias("seq"))


def _over(overlay: DataFrame, first: DataFrame, rounds: list[int] | None) -> DataFrame:
    """The labels of all entries that ``first`` reach over the overlay (u, v, cost, link_id)."""
    step = overlay.agg(F.avg("cost")).first()[0]
    if step is None:
        return first
    step = max(2 * step, 1e-300)
    tables, bound, k = [first.withColumn("seq", F.lit(0))], 0.0, 0
    while True:
        best = _best(tables)
        # Labels below the bound have been sent, but for those of the round before.
        waiting = best.where((F.col("seq") >= k) | (F.col("dist") >= bound))
        least = waiting.agg(F.min("dist")).first()[0]
        if least is None:
            return best.drop("seq")
        bound = max(bound, (least // step + 1) * step)
        k += 1
        if rounds is not None:
            rounds.append(k)
        sent = waiting.where(F.col("dist") < bound).select("source", F.col("node").alias("u"), "dist").join(overlay, "u").where(F.col("v") != F.col("source"))
        sent = sent.groupBy("source", F.col("v").alias("node")).agg(F.min(F.struct((F.col("dist") + F.col("cost")).alias("dist"), "link_id")).alias("new"))
        held = best.select("source", "node", F.col("dist").alias("_d"), F.col("link_id").alias("_l"))
        better = F.col("_d").isNull() | (F.col("new.dist") < F.col("_d")) | ((F.col("new.dist") == F.col("_d")) & (F.col("new.link_id") < F.col("_l")))
        fresh = sent.join(held, ["source", "node"], "left").where(better)
        tables.append(cut(fresh.select("source", "node", F.col("new.dist").alias("dist"), F.col("new.link_id").alias("link_id"), F.lit(k).alias("seq"))))
        if len(tables) > TABLES:
            merged = cut(_best(tables))
            drop(*tables)
            tables = [merged]


def overlay_labels(links: DataFrame, sources: DataFrame, part_links: int = PART_LINKS, rounds: list[int] | None = None) -> DataFrame:
    """(source, node, dist, link_id) of all nodes that each of ``sources`` reaches over ``links`` (link_id, u, v, cost).

    The same labels as :func:`.paths.relax` gives, up to the rounding of sums taken in
    another order.  ``rounds`` gets the number of each round over the overlay.
    """
    parts = cut(cut_parts(links, part_links))
    of = lambda c: parts.select(F.col("node").alias(c), F.col("part").alias(f"p{c}"))
    tagged = cut(links.select("link_id", "u", "v", "cost").join(of("u"), "u").join(of("v"), "v"))
    inner = tagged.where("pu = pv").select("link_id", "u", "v", "cost", F.col("pu").alias("part"))
    cross = tagged.where("pu <> pv")
    first = cut(sources.select("source").distinct().select("source", F.col("source").alias("node"), F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("link_id")))
    best = first
    if not cross.isEmpty():
        starts = cross.select(F.col("v").alias("node")).unionByName(first.select("node")).distinct().withColumn("start", F.lit(True))
        exits = cross.select(F.col("u").alias("node")).distinct().withColumn("exit", F.lit(True))
        marks = starts.join(exits, "node", "full").join(parts, "node").select("part", "node", F.coalesce("start", F.lit(False)).alias("start"), F.coalesce("exit", F.lit(False)).alias("exit"))
        ways = _shortcuts(inner, marks).join(cross.select("u", "v", "cost", "link_id"), "u")
        ways = ways.groupBy(F.col("start").alias("u"), "v").agg(F.min(F.struct((F.col("dist") + F.col("cost")).alias("cost"), "link_id")).alias("w"))
        overlay = cut(ways.select("u", "v", F.col("w.cost").alias("cost"), F.col("w.link_id").alias("link_id")))
        best = cut(_over(overlay, first, rounds))
        drop(overlay)
    shares = -(-first.count() // SOURCES)
    share = F.pmod(F.xxhash64("source"), F.lit(shares)).cast("int").alias("share")
    at = best.join(parts, "node", "left").select("source", "node", "dist", "link_id", "part", share)
    spread = inner.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(max(shares, 1) - 1))))

    def run(links_, labels):
        graph, cost = _graph(links_)
        out = []
        for source, own in labels.groupby("source"):
            own = [(int(n), float(d), None if pd.isna(x) else int(x)) for n, d, x in zip(own["node"], own["dist"], own["link_id"].astype("Int64"))]
            out.extend((source, *row) for row in settle(graph, cost, own))
        return pd.DataFrame({c: pd.array([r[i] for r in out], "Float64" if c == "dist" else "Int64") for i, c in enumerate(("source", "node", "dist", "link_id"))})

    inside = spread.groupBy("part", "share").cogroup(at.where("part is not null").groupBy("part", "share")).applyInPandas(run, LABELS)
    return cut(inside.unionByName(at.where("part is null").select("source", "node", "dist", "link_id")))
