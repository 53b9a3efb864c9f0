"""One-to-many shortest paths.

Two plans answer the same question.  Where the network is of a checked size its adjacency
is broadcast and every source is searched by one task, once for all of its targets.  Any
network can be relaxed set at a time with joins and minima.  Costs must not be negative;
of equally short links into a node the one of the lowest id is the parent.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut, drop

if TYPE_CHECKING:
    from .corridor import Core

#: Links up to which the adjacency is broadcast: arrays of 32 bytes a link, and 8 bytes for each vector of costs.
MAX_BROADCAST_LINKS = 4_000_000
#: Links of a path that :func:`backtrack` walks in one round, as a power of two.
STRIDE_BITS = 4
#: Distances that a task holds at once, and trips that it gathers for them.
SLOTS, TRIPS = 250_000, 200_000
#: Paths that a task hands on at once.
PATHS_A_BATCH = 10_000
#: Links looked at, as a multiple of those within reach, after which a heap searches source by source.
PATIENCE = 40


def weak_components(n: int, tail: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The component, links taken both ways, of each of ``n`` places, named by its smallest place."""
    label = np.arange(n)
    while True:
        a, b = label[tail], label[head]
        apart = a != b
        if not apart.any():
            return label
        tail, head = tail[apart], head[apart]
        # Every root with a smaller neighbour joins one, so the roots halve.
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(further := label[label], label):
            label = further


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of the ``count`` numbers from ``first`` on of each row."""
    row = np.repeat(np.arange(len(first)), count)
    return row, np.arange(len(row)) + np.repeat(first - (np.cumsum(count) - count), count)


class Adjacency:
    """Outgoing links by node, in arrays; each process makes the lists that it searches once."""

    def __init__(self, link_id: np.ndarray, u: np.ndarray, v: np.ndarray):
        names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
        tail, head = ends[: len(u)], ends[len(u) :]
        order = np.lexsort((link_id, tail))
        self.names = names
        self.link_id, self.heads, self.tail = link_id[order], head[order].astype(np.int32), tail[order].astype(np.int32)
        self.firsts = np.searchsorted(self.tail, np.arange(len(names) + 1))
        self.order = order
        self._lists = self._slabs = None

    def __getstate__(self):
        return self.__dict__ | {"_lists": None}

    @property
    def slabs(self) -> tuple[np.ndarray, ...]:
        """By node its place within its component and that one's nodes and links; positions by head and id, and the first by node; its component."""
        if self._slabs is None:
            n = len(self.names)
            part = weak_components(n, self.tail, self.heads)
            sizes, links = np.bincount(part, minlength=n), np.bincount(part[self.tail], minlength=n)
            order = np.argsort(part, kind="stable")
            local = np.empty(n, np.int32)
            local[order] = np.arange(n) - (np.cumsum(sizes) - sizes)[part[order]]
            into = np.lexsort((self.link_id, self.heads)).astype(np.int32)
            self._slabs = local, sizes[part], links[part], into, np.searchsorted(self.heads[into], np.arange(n + 1)), part
        return self._slabs

    @property
    def component(self) -> np.ndarray:
        """A number by node that its component's nodes share."""
        return self.slabs[5]

    def places(self, nodes: np.ndarray) -> np.ndarray:
        """The places of nodes, -1 of those unknown."""
        at = np.minimum(np.searchsorted(self.names, nodes), len(self.names) - 1)
        return np.where(self.names[at] == nodes, at, -1) if len(self.names) else np.full(len(nodes), -1)

    @property
    def lists(self) -> tuple[dict[int, int], list[int], list[int]]:
        """(place by node, head by link, first link by place)."""
        if self._lists is None:
            self._lists = {int(n): i for i, n in enumerate(self.names)}, self.heads.tolist(), self.firsts.tolist()
        return self._lists

    @property
    def nodes(self) -> dict[int, int]:
        return self.lists[0]

    def search(self, source: int, cost: list[float]) -> tuple[list[float], list[int], list[int]]:
        """(distance, position of the parent link or -1) by node, and the nodes from near to far.

        ``cost`` is in the order of ``order``.
        """
        nodes, head, first = self.lists
        n = len(nodes)
        dist, parent, done, reached = [float("inf")] * n, [-1] * n, [False] * n, []
        start = nodes.get(source)
        if start is None:
            return dist, parent, reached
        dist[start] = 0.0
        queue = [(0.0, start)]
        ids = self.link_id
        while queue:
            d, i = heapq.heappop(queue)
            if done[i]:
                continue
            done[i] = True
            reached.append(i)
            for k in range(first[i], first[i + 1]):
                j = head[k]
                if done[j]:
                    continue
                new = d + cost[k]
                if new < dist[j]:
                    dist[j], parent[j] = new, k
                    heapq.heappush(queue, (new, j))
                elif new == dist[j] and ids[k] < ids[parent[j]]:
                    parent[j] = k
        return dist, parent, reached

    def push(self, parent: list[int], reached: list[int], volume: dict[int, float], flow: np.ndarray) -> None:
        """Add to ``flow`` by link what the volumes at nodes make of the tree of ``parent``.

        Nodes are taken from far to near, each sending all that has come to it over its
        parent link, so a tree takes a step for each node however many paths it holds.
        """
        for i in reversed(reached):
            here = volume.pop(i, 0.0)
            k = parent[i]
            if here and k >= 0:
                flow[k] += here
                up = int(self.tail[k])
                volume[up] = volume.get(up, 0.0) + here

    def path(self, source: int, target: int, parent: list[int]) -> list[int]:
        """The positions of the links from source to target."""
        out, at, start = [], self.nodes[target], self.nodes[source]
        while at != start:
            out.append(parent[at])
            at = int(self.tail[parent[at]])
        return out[::-1]


class Forest:
    """The distances from several sources (places), each in a slab for the nodes of its component, and trees of shortest paths."""

    def __init__(self, graph: Adjacency, sources: np.ndarray, cost: np.ndarray):
        self.graph, self.sources, self.cost = graph, sources, cost
        self.local, held, near, self.into, self.before, _ = graph.slabs
        self.base = np.concatenate([[0], np.cumsum(held[sources])])
        self.start = self.base[:-1] + self.local[sources]
        self.dist = np.full(self.base[-1], np.inf)
        self.parent = None  # of each slot, where a heap has found it
        self._search(PATIENCE * int(near[sources].sum()) + 1000)

    def slot(self, source: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The slots of nodes for the sources of the given numbers, -1 of those in another component."""
        at = self.base[source] + self.local[node]
        return np.where(self.graph.component[node] == self.graph.component[self.sources[source]], at, -1)

    def distances(self, at: np.ndarray) -> np.ndarray:
        """Those of slots, infinite without a path or a slot."""
        return np.where(at >= 0, self.dist[at], np.inf) if len(self.dist) else np.full(len(at), np.inf)

    def rows(self, at: np.ndarray) -> np.ndarray:
        """The rows of slots in the trees, -1 of sources."""
        return self.row[at]

    def _search(self, left: int) -> None:
        """Labels that fell are sent on, those of all sources at once."""
        graph, dist, local = self.graph, self.dist, self.local
        dist[self.start] = 0.0
        last = np.empty(len(dist), np.int32)
        node, at = self.sources, self.start
        while len(node):
            row, k = _spread(graph.firsts[node], graph.firsts[node + 1] - graph.firsts[node])
            left -= len(k) + len(node)
            if left < 0:
                return self._by_heap()
            head = graph.heads[k]
            to, new = (at - local[node])[row] + local[head], dist[at][row] + self.cost[k]
            fell = np.flatnonzero(new < dist[to])
            to, head = to[fell], head[fell]
            np.minimum.at(dist, to, new[fell])
            last[to] = np.arange(len(to))
            once = last[to] == np.arange(len(to))
            node, at = head[once], to[once]

    def _by_heap(self) -> None:
        cost = self.cost.tolist()
        self.parent = np.full(len(self.dist), -1)
        for i, s in enumerate(self.graph.names[self.sources].tolist()):
            dist, parent, reached = self.graph.search(s, cost)
            at = self.base[i] + self.local[reached]
            self.dist[at], self.parent[at] = np.array(dist)[reached], np.array(parent)[reached]

    def grow(self, at: np.ndarray, node: np.ndarray) -> None:
        """Make the trees to nodes that are reached, given by their slots as well.

        ``link`` are the parent links of the nodes on the way, ``up`` the rows of the nodes before
        (-1: a source), ``row`` gives a slot's row (-1 of sources and nodes off the way).
        """
        if not self._grown(at, node):
            self._by_heap()
            self._grown(at, node)

    def _grown(self, at: np.ndarray, node: np.ndarray) -> bool:
        """False where a link without length leads to a node on the way: which of its ends comes first, a heap must say."""
        graph, dist, local = self.graph, self.dist, self.local
        self.row = np.full(len(dist), -1, np.int32)
        roots = np.zeros(len(dist), bool)
        roots[self.start] = True
        links, ups, rows = [], [], 0
        while True:
            at, first = np.unique(at, return_index=True)
            new = (self.row[at] < 0) & ~roots[at]
            at, node = at[new], node[first][new]
            if not len(at):
                break
            self.row[at] = np.arange(rows, rows + len(at))
            rows += len(at)
            slab = at - local[node]
            if self.parent is not None:
                link = self.parent[at]
            else:
                row, k = _spread(self.before[node], self.before[node + 1] - self.before[node])
                k = self.into[k]
                own, behind = dist[at][row], dist[slab[row] + local[graph.tail[k]]]
                tight = behind + self.cost[k] == own
                if (tight & (behind >= own)).any():
                    return False
                tight = np.flatnonzero(tight)
                link = k[tight[np.flatnonzero(np.diff(row[tight], prepend=-1))]]  # the lowest id comes first
            node = graph.tail[link]
            at = slab + local[node]
            links.append(link)
            ups.append(at)
        none = np.zeros(0, np.int64)
        self.link = np.concatenate([none, *links])
        self.up = self.row[np.concatenate([none, *ups])]
        return True

    def depths(self) -> np.ndarray:
        """The number of links to each row's node, by doubling."""
        up = np.r_[self.up, -1].astype(np.int64)  # the last row stands for the sources
        depth = np.r_[np.ones(len(self.up), np.int64), 0]
        while (up[:-1] >= 0).any():
            depth, up = depth + depth[up], up[up]
        return depth[:-1]

    def push(self, at: np.ndarray, volume: np.ndarray, flow: np.ndarray) -> None:
        """Add to ``flow`` by link what volumes at slots make of the trees, from the deepest nodes on."""
        row = self.rows(at)
        here = np.zeros(len(self.link))
        np.add.at(here, row[row >= 0], volume[row >= 0])
        depth = self.depths()
        order = np.argsort(-depth, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
            up = self.up[rows]
            np.add.at(here, up[up >= 0], here[rows][up >= 0])
        np.add.at(flow, self.link, here)

    def paths(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids of links) of the paths to slots; a source's own is empty."""
        row = self.rows(at).astype(np.int64)
        length = np.where(row >= 0, np.r_[self.depths(), 0][row], 0)
        ends = np.cumsum(length)
        out, place = np.empty(length.sum(), np.int64), ends - 1
        while len(row):
            on = row >= 0
            row, place = row[on], place[on]
            out[place] = self.graph.link_id[self.link[row]]
            row, place = self.up[row].astype(np.int64), place - 1
        return np.concatenate([[0], ends]), out


def _forests(batches: Iterator[pa.RecordBatch], graph: Adjacency, cost: np.ndarray, core: Core | None = None, trees: bool = True) -> Iterator[tuple]:
    """(rows, forest, slots, targets' places): trips in order of their sources with the search that serves them.

    Slots of trips without a path, or from unknown nodes, are -1.  Trips are gathered so
    that one search serves several sources.  With a core both ends are searched (:mod:`.corridor`).
    """
    from .corridor import LABELS, Corridor

    held: list[pa.RecordBatch] = []
    number = 0

    def ready(last: bool):
        nonlocal held, number
        table = pa.Table.from_batches(held)
        source = table["source"].to_numpy()
        firsts = np.flatnonzero(np.r_[True, source[1:] != source[:-1]])
        # The last source's trips may go on in the next batch.
        upto = len(source) if last or len(firsts) == 1 else int(firsts[-1])
        held = table.slice(upto).combine_chunks().to_batches()
        number = len(source) - upto
        firsts = firsts[firsts < upto]
        place = graph.places(source[firsts])
        room = np.cumsum(np.where(place >= 0, graph.slabs[1][place], 1) if len(graph.names) else np.ones(len(place), np.int64))
        i = 0
        while i < len(firsts):
            j = max(i + 1, int(np.searchsorted(room, room[i] + SLOTS))) if core is None else min(len(firsts), i + max(1, LABELS // core.size))
            a, b = int(firsts[i]), int(firsts[j]) if j < len(firsts) else upto
            rows = table.slice(a, b - a)
            known = np.flatnonzero(place[i:j] >= 0)
            which = np.full(j - i, -1)
            which[known] = np.arange(len(known))
            which = which[np.searchsorted(firsts[i:j], np.arange(a, b), side="right") - 1]
            target = graph.places(rows["target"].to_numpy())
            ok = np.flatnonzero((which >= 0) & (target >= 0))
            sources = place[i:j][known]
            forest = Forest(graph, sources, cost) if core is None else Corridor(graph, sources, cost, core, which[ok], target[ok], trees)
            slots = np.full(b - a, -1)
            slots[ok] = forest.slot(which[ok], target[ok])
            slots[np.isinf(forest.distances(slots))] = -1
            yield rows, forest, slots, target
            i = j

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            number += batch.num_rows
        if number >= TRIPS:
            yield from ready(False)
    if number:
        yield from ready(True)


def _trip_costs(rows: pa.Table, forest: Forest, slots: np.ndarray) -> pa.Array:
    """Null where there is no path; trips to their own source cost nothing."""
    cost = np.where(slots >= 0, forest.distances(slots), 0.0)
    own = rows["source"].to_numpy() == rows["target"].to_numpy()
    cost[own] = 0.0
    return pa.array(cost, mask=(slots < 0) & ~own)


def adjacency(links: DataFrame, max_links: int = MAX_BROADCAST_LINKS) -> tuple[Adjacency, pd.DataFrame] | None:
    """The adjacency and the links by position if there are at most ``max_links``, else None."""
    rows = links.limit(max_links + 1).toArrow()
    if rows.num_rows > max_links:
        return None
    rows = rows.to_pandas()
    a = Adjacency(rows["link_id"].to_numpy(), rows["u"].to_numpy(), rows["v"].to_numpy())
    a.slabs  # noqa: B018  # made once, before it is sent
    return a, rows.iloc[a.order].reset_index(drop=True)


TRIP_PATHS = "trip_id long, source long, target long, volume double, cost double, links array<long>"


def path_batches(batches: Iterator[pa.RecordBatch], graph: Adjacency, cost: np.ndarray, core: Core | None = None) -> Iterator[pa.RecordBatch]:
    """TRIP_PATHS of trips in order of their sources."""
    for rows, forest, slots, node in _forests(batches, graph, cost, core):
        there = np.flatnonzero(slots >= 0)
        forest.grow(slots[there], node[there])
        best = _trip_costs(rows, forest, slots)
        ends, links = forest.paths(slots[there])
        length = np.zeros(len(slots), np.int64)
        length[there] = np.diff(ends)
        offsets = pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.array(links, pa.int64()), mask=pc.is_null(best))
        named = {c: rows[c].combine_chunks() for c in ("trip_id", "source", "target", "volume")}
        yield from pa.table(named | {"cost": best, "links": lists}).to_batches(PATHS_A_BATCH)


def search_trips(demand: DataFrame, held: Adjacency | Broadcast, cost: np.ndarray | Broadcast, core: Broadcast | None = None) -> DataFrame:
    """The best path of each trip by broadcast adjacency: TRIP_PATHS, null cost and links if unreachable.

    A search serves all of a source's trips in a task; hot sources are spread by trip, at
    the price of a search in each task that has one.  What is broadcast already is used as
    it is, so that a caller can send the network once and destroy the costs of a step.
    """
    context = demand.sparkSession.sparkContext
    network, prices = (x if isinstance(x, Broadcast) else context.broadcast(x) for x in (held, cost))
    rows = demand.select("trip_id", "source", "target", F.col("volume").cast("double").alias("volume")).sortWithinPartitions("source", "trip_id")
    return rows.mapInArrow(lambda batches: path_batches(batches, network.value, prices.value, core and core.value), TRIP_PATHS)


LINK_SUMS = "link_id long, flow double, best double, volume double"


def load_batches(batches: Iterator[pa.RecordBatch], graph: Adjacency, cost: np.ndarray, core: Core | None = None) -> Iterator[pa.RecordBatch]:
    """LINK_SUMS of trips in order of their sources: a row for each used link, and one without a link."""
    flow = np.zeros(len(graph.link_id))
    best = total = 0.0
    for rows, forest, slots, node in _forests(batches, graph, cost, core):
        volume = rows["volume"].to_numpy()
        total += float(volume.sum())
        there = np.flatnonzero((slots >= 0) & (rows["source"].to_numpy() != rows["target"].to_numpy()))
        slots, volume = slots[there], volume[there]
        best += float(volume @ forest.distances(slots))
        forest.grow(slots, node[there])
        forest.push(slots, volume, flow)
    used = np.flatnonzero(flow)
    yield pa.RecordBatch.from_pydict({"link_id": graph.link_id[used], "flow": flow[used], "best": np.zeros(len(used)), "volume": np.zeros(len(used))})
    yield pa.RecordBatch.from_pydict({"link_id": pa.array([None], pa.int64()), "flow": [0.0], "best": [best], "volume": [total]})


def link_sums(found: DataFrame) -> DataFrame:
    return found.groupBy("link_id").agg(*(F.sum(c).alias(c) for c in ("flow", "best", "volume")))


def load_trips(demand: DataFrame, held: Adjacency | Broadcast, cost: np.ndarray | Broadcast, core: Broadcast | None = None) -> DataFrame:
    """(link_id, flow, best, volume) of loading every trip on its best path, without making a path.

    A row for each used link, and one without a link for the trips' best travel time and
    volume.  Each task pushes the volumes of a source down its tree and sends sums by link,
    which are added up by link.
    """
    context = demand.sparkSession.sparkContext
    network, prices = (x if isinstance(x, Broadcast) else context.broadcast(x) for x in (held, cost))
    rows = demand.select("source", "target", F.col("volume").cast("double").alias("volume")).sortWithinPartitions("source")
    return link_sums(rows.mapInArrow(lambda batches: load_batches(batches, network.value, prices.value, core and core.value), LINK_SUMS))


TRIP_COSTS = "trip_id long, source long, target long, volume double, cost double"


def cost_batches(batches: Iterator[pa.RecordBatch], graph: Adjacency, cost: np.ndarray, core: Core | None = None) -> Iterator[pa.RecordBatch]:
    """TRIP_COSTS of trips in order of their sources."""
    for rows, forest, slots, _ in _forests(batches, graph, cost, core, trees=False):
        yield from rows.append_column("cost", _trip_costs(rows, forest, slots)).to_batches()


def search_costs(demand: DataFrame, held: Adjacency | Broadcast, cost: np.ndarray | Broadcast, core: Broadcast | None = None) -> DataFrame:
    """The cost of each trip's best path (trip_id, source, target, volume, cost), null if unreachable."""
    context = demand.sparkSession.sparkContext
    network, prices = (x if isinstance(x, Broadcast) else context.broadcast(x) for x in (held, cost))
    rows = demand.select("trip_id", "source", "target", F.col("volume").cast("double").alias("volume")).sortWithinPartitions("source", "trip_id")
    return rows.mapInArrow(lambda batches: cost_batches(batches, network.value, prices.value, core and core.value), TRIP_COSTS)


def by_source(demand: DataFrame, tasks: int | None = None) -> DataFrame:
    """Demand dealt out so that the trips of a source share a task, at most 65536 of them in one."""
    spark = demand.sparkSession
    tasks = tasks or max(spark.sparkContext.defaultParallelism, 1)
    salt = F.floor(F.col("trip_id") / 65536)  # trips of a source are numbered together
    return demand.repartition(tasks, "source", salt)


def relax(links: DataFrame, sources: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(source, node, dist, link_id) of all reachable nodes, by rounds of relaxation.

    ``links`` has link_id, u, v and cost, ``sources`` the column source.  Each round sends
    only the labels that changed over their links.  ``link_id`` is the parent (null at the
    source).  At most ``max_rounds`` rounds run, by default until nothing changes.
    """
    best = cut(sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("link_id")).distinct())
    frontier = held = best
    edges = links.select("link_id", "u", "v", "cost")
    rounds = 0
    while not frontier.isEmpty() and (max_rounds is None or rounds < max_rounds):
        sent = frontier.select("source", F.col("node").alias("u"), "dist").join(edges, "u").where(F.col("v") != F.col("source"))
        sent = sent.groupBy("source", F.col("v").alias("node")).agg(F.min(F.struct((F.col("dist") + F.col("cost")).alias("dist"), "link_id")).alias("new"))
        both = best.join(sent, ["source", "node"], "full")
        better = F.col("new").isNotNull() & (F.col("dist").isNull() | (F.col("new.dist") < F.col("dist")) | ((F.col("new.dist") == F.col("dist")) & (F.col("new.link_id") < F.col("link_id"))))
        best_new = both.select(
            "source",
            "node",
            F.when(better, F.col("new.dist")).otherwise(F.col("dist")).alias("dist"),
            F.when(better, F.col("new.link_id")).otherwise(F.col("link_id")).alias("link_id"),
            (better & (F.col("dist").isNull() | (F.col("new.dist") < F.col("dist")))).alias("_moved"),
        )
        labelled = cut(best_new)
        drop(held)
        held, best, frontier = labelled, labelled.drop("_moved"), labelled.where("_moved").drop("_moved")
        rounds += 1
    return best


def backtrack(labels: DataFrame, links: DataFrame, demand: DataFrame) -> DataFrame:
    """The best path of each trip (TRIP_PATHS) from the labels of :func:`relax`.

    Each label's way towards its source is doubled STRIDE_BITS times first, so that a round
    takes 2 ** STRIDE_BITS links of all open paths, and paths of n links take n / 2 **
    STRIDE_BITS rounds.
    """
    labels = labels.where("link_id is not null").select("source", F.col("node").alias("at"), "link_id")
    steps = cut(labels.join(links.select("link_id", F.col("u").alias("before")), "link_id").select("source", "at", "before", F.array("link_id").alias("way")))
    for _ in range(STRIDE_BITS):
        further = steps.select("source", F.col("at").alias("before"), F.col("before").alias("_before"), F.col("way").alias("_way"))
        joined = steps.join(further, ["source", "before"], "left")
        longer = cut(joined.select("source", "at", F.coalesce("_before", "before").alias("before"), F.concat(F.coalesce("_way", F.array().cast("array<long>")), "way").alias("way")))
        drop(steps)
        steps = longer
    ends = demand.select("trip_id", "source", "target", "volume")
    done = ends.where("source = target").select("trip_id", F.array().cast("array<long>").alias("links"))
    walk = cut(ends.where("source <> target").select("trip_id", "source", F.col("target").alias("at"), F.array().cast("array<long>").alias("links")))
    while not walk.isEmpty():
        moved = cut(walk.join(steps, ["source", "at"]).select("trip_id", "source", F.col("before").alias("at"), F.concat("way", "links").alias("links")))
        done = done.unionByName(moved.where("at = source").select("trip_id", "links"))
        walk = moved.where("at <> source")
    return ends.join(done, "trip_id", "left")


def push_volumes(labels: DataFrame, links: DataFrame, demand: DataFrame) -> DataFrame:
    """(link_id, flow) of loading every trip on the trees of ``labels``, without making a path.

    What flows over a node's parent link is the volume of all nodes below it.  In round k
    each node sends the sum of those at most 2 ** k - 1 links below to the node 2 ** k links above
    and then looks twice as far, so paths of n links take log2(n) rounds.
    """
    ends = demand.where("source <> target").groupBy("source", F.col("target").alias("node")).agg(F.sum("volume").alias("flow"))
    tree = labels.where("link_id is not null").select("source", "node", "link_id").join(links.select("link_id", F.col("u").alias("up")), "link_id")
    tree = tree.withColumn("up", F.when(F.col("up") != F.col("source"), F.col("up")))
    state = cut(tree.join(ends, ["source", "node"], "left").select("source", "node", "link_id", "up", F.coalesce("flow", F.lit(0.0)).alias("flow")))
    while not state.where("up is not null").isEmpty():
        sent = state.where("up is not null and flow > 0").groupBy("source", F.col("up").alias("node")).agg(F.sum("flow").alias("_more"))
        above = state.select("source", F.col("node").alias("up"), F.col("up").alias("_next"))
        moved = state.join(sent, ["source", "node"], "left").join(above, ["source", "up"], "left")
        moved = cut(moved.select("source", "node", "link_id", F.col("_next").alias("up"), (F.col("flow") + F.coalesce("_more", F.lit(0.0))).alias("flow")))
        drop(state)
        state = moved
    return state.where("flow > 0").groupBy("link_id").agg(F.sum("flow").alias("flow"))


def tree_labels(links: DataFrame, sources: DataFrame) -> DataFrame:
    """The labels of :func:`relax`, over the overlay of the network's parts (:mod:`.overlay`)."""
    from .overlay import overlay_labels

    return overlay_labels(links, sources)


def trip_costs(links: DataFrame, demand: DataFrame, max_links: int = MAX_BROADCAST_LINKS, strategy: str = "auto") -> DataFrame:
    """(trip_id, source, target, volume, cost) of each trip's best path, which isn't made; null if unreachable."""
    held = held_network(links, max_links, strategy)
    if held is not None:
        return search_costs(by_source(demand), *sent(demand, *held))
    from .whole import by_components, left_over

    found, rest = by_components(links, demand, cost_batches, TRIP_COSTS)
    if rest is None:
        return found
    links, trips = rest
    held = left_over(links, trips)
    if held is not None:
        return found.unionByName(search_costs(by_source(trips), *held))
    return found.unionByName(with_costs(trips, tree_labels(links, trips.select("source").distinct())))


def with_costs(trips: DataFrame, labels: DataFrame) -> DataFrame:
    costs = labels.select("source", F.col("node").alias("target"), F.col("dist").alias("cost"))
    found = trips.join(costs, ["source", "target"], "left")
    return found.select(*trips.columns, F.when(F.col("source") == F.col("target"), F.lit(0.0)).otherwise(F.col("cost")).alias("cost"))


def held_network(links: DataFrame, max_links: int, strategy: str):
    if strategy not in ("auto", "search", "relax"):
        raise ValueError(f"strategy must be auto, search or relax, not {strategy}")
    held = adjacency(links.select("link_id", "u", "v", "cost"), max_links) if strategy != "relax" else None
    if held is None and strategy == "search":
        raise ValueError(f"the network has over {max_links} links")
    return held


def sent(demand: DataFrame, graph: Adjacency, rows: pd.DataFrame) -> tuple[Adjacency, np.ndarray, Broadcast | None]:
    """What a search of all trips takes: the adjacency, the costs and, where both ends are to be searched, the core."""
    from .corridor import prepared

    cost = rows["cost"].to_numpy(float)
    return graph, cost, prepared(demand, graph, cost)


def shortest_paths(links: DataFrame, demand: DataFrame, max_links: int = MAX_BROADCAST_LINKS, strategy: str = "auto") -> DataFrame:
    """The best path of each trip (TRIP_PATHS); ``strategy``: auto, search or relax."""
    held = held_network(links, max_links, strategy)
    if held is not None:
        return search_trips(by_source(demand), *sent(demand, *held))
    from .whole import by_components, left_over

    found, rest = by_components(links, demand, path_batches, TRIP_PATHS)
    if rest is None:
        return found
    links, trips = rest
    held = left_over(links, trips)
    if held is not None:
        return found.unionByName(search_trips(by_source(trips), *held))
    labels = tree_labels(links, trips.select("source").distinct())
    return found.unionByName(with_costs(backtrack(labels, links, trips), labels).select(*found.columns))


def best_costs(trip_paths: DataFrame, strict: bool = False) -> DataFrame:
    """(trip_id, cost): null if unreachable, with ``strict`` -1.0 as a sentinel."""
    cost = F.coalesce("cost", F.lit(-1.0)) if strict else F.col("cost")
    return trip_paths.select("trip_id", cost.alias("cost"))
