"""Searches from both ends, exact to the last bit, for many sources on one large network.

Nodes that few links meet are left out: a step of the core goes through one of them, its two
costs added one after the other as along the links.  Each node of the core gets its nearest
nodes upstream, once.  A search then settles the nodes near its source, bounds its targets'
distances by what both sides have met, and goes on only where a shortest path, or one as
short, can lead: a node further off keeps a label too long and is on none of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame

from ..scratch import cut, drop
from .paths import Adjacency, Forest, _spread

#: Nodes of a core from which on both ends are searched, and sources for each of so many of its nodes.
LEAST_CORE, CORE_A_SOURCE = 4_000, 64
#: Nearest nodes upstream that a node has (fewer in cores of over 131,072 nodes, so that all hold 256 MB), and nodes that a search settles at first, about.
BALL, BALLS, SETTLED = 256, 1 << 25, 400
#: Labels that a task holds at once.
LABELS = 250_000
#: Share of a distance within which paths are followed up as equally short, well above the rounding of sums.
SLACK = 1e-6


def _once(at: np.ndarray, last: np.ndarray) -> np.ndarray:
    last[at] = np.arange(len(at), dtype=np.int32)
    return at[last[at] == np.arange(len(at))]


def _upto(firsts: np.ndarray, weight: np.ndarray, node: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The end of each node's steps, lightest first, that weigh ``room`` at most."""
    low, high = firsts[node].copy(), firsts[node + 1].copy()
    while (on := low < high).any():
        middle = (low + high) >> 1
        fits = on & (weight[np.minimum(middle, len(weight) - 1)] <= room)
        low, high = np.where(fits, middle + 1, low), np.where(on & ~fits, middle, high)
    return low


class Core:
    """The network without nodes whose ways through are at most their links, no two of them neighbours; at given costs."""

    def __init__(self, graph: Adjacency, cost: np.ndarray):
        n, tail, head = len(graph.names), graph.tail, graph.heads
        outs, ins = np.bincount(tail, minlength=n), np.bincount(head, minlength=n)
        # Of neighbours that could both go, the one of the least lot does.
        lot = np.where(outs * ins <= outs + ins, (np.arange(n) * 2654435761) & 0xFFFFFFFF, 1 << 40)
        near = np.full(n, 1 << 40)
        np.minimum.at(near, tail, lot[head])
        np.minimum.at(near, head, lot[tail])
        through = lot < near
        self.place = np.where(through, -1, np.cumsum(~through) - 1).astype(np.int32)
        self.size = int(n - through.sum())
        into, first = graph.slabs[3], graph.firsts
        direct = np.flatnonzero(~through[tail] & ~through[head] & (tail != head))
        there = np.flatnonzero(through[head])
        row, back = _spread(first[head[there]], first[head[there] + 1] - first[head[there]])
        there = there[row]
        other = tail[there] != head[back]
        there, back = there[other], back[other]
        a, b = (self.place[np.concatenate(x)] for x in ((tail[direct], tail[there]), (head[direct], head[back])))
        one, two = np.concatenate([cost[direct], cost[there]]), np.concatenate([np.zeros(len(direct)), cost[back]])
        order = np.lexsort((one + two, a))
        self.head, self.one, self.two = b[order], one[order], two[order]
        self.into = np.concatenate([direct, back])[order].astype(np.int32)  # the position of a step's last link
        self.weight = self.one + self.two
        self.firsts = np.searchsorted(a[order], np.arange(self.size + 1))
        self.ball = min(BALL, max(8, BALLS // max(self.size, 1)))
        self.near = self.span = self.reach = self.radius = None

    def __getstate__(self):
        return self.__dict__ | {"weight": None}  # made again where it is received

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.weight = self.one + self.two

    def upstream(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first by node, node before, weight): the steps into each node, lightest first."""
        order = np.lexsort((self.weight, self.head))
        tail = np.repeat(np.arange(self.size, dtype=np.int32), np.diff(self.firsts))
        return np.searchsorted(self.head[order], np.arange(self.size + 1)), tail[order], self.weight[order]

    def pilot(self, steps: tuple[np.ndarray, np.ndarray, np.ndarray], number: int) -> float:
        """The distance within which some nodes, drawn evenly, have ``number`` others, in the middle of them."""
        drawn = np.unique(np.linspace(0, self.size - 1, 15).astype(np.int64))
        room, least = float(steps[2].mean()) / 8 if len(steps[2]) else 0.0, min(number, self.size // 2)
        for _ in range(60):
            counts = np.array([len(within(steps, np.array([d]), self.size, room)[0]) for d in drawn])
            if np.median(counts) >= least or room == 0.0:
                break
            room *= 1.15
        return room

    def balls(self, nodes: np.ndarray, steps: tuple[np.ndarray, np.ndarray, np.ndarray], room: float) -> pa.RecordBatch:
        """(node, near, span, reach): up to ``ball`` nodes upstream, nearest first; all nearer than ``reach`` are among them.

        Nodes that have few others within ``room``, though there are more, look further.
        """
        k = self.ball
        slot, dist, reach = within(steps, nodes, self.size, room)
        which = slot // self.size
        while len(few := np.flatnonzero((np.bincount(which, minlength=len(nodes)) < k // 4) & np.isfinite(reach))):
            room = max(2 * room, float(reach[few].min()))
            more, further, reach[few] = within(steps, nodes[few], self.size, room)
            kept = ~np.isin(which, few)
            slot = np.concatenate([slot[kept], few[more // self.size] * self.size + more % self.size])
            dist, which = np.concatenate([dist[kept], further]), slot // self.size
        order = np.lexsort((dist, which))
        slot, dist, which = slot[order], dist[order], which[order]
        rank = np.arange(len(which)) - np.searchsorted(which, np.arange(len(nodes)))[which]
        near, span = np.zeros((len(nodes), k), np.int32), np.full((len(nodes), k), np.inf, np.float32)
        reach[which[rank == k]] = dist[rank == k]
        held = rank < k
        near[which[held], rank[held]], span[which[held], rank[held]] = slot[held] % self.size, dist[held]
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), k).cast(pa.list_(t)) for x, t in ((near, pa.int32()), (span, pa.float32()))]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), *lists, pa.array(reach)], ["node", "near", "span", "reach"])

    def hold(self, balls: pa.Table) -> None:
        """Take what :meth:`balls` made for all nodes."""
        node = balls["node"].to_numpy()
        self.near, self.span = np.empty((self.size, self.ball), np.int32), np.empty((self.size, self.ball), np.float32)
        for name in ("near", "span"):
            getattr(self, name)[node] = pc.list_flatten(balls[name]).to_numpy().reshape(-1, self.ball)
        self.reach = np.empty(self.size)
        self.reach[node] = balls["reach"].to_numpy()


def within(steps: tuple[np.ndarray, np.ndarray, np.ndarray], nodes: np.ndarray, size: int, room: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, distances) of all within ``room`` of each of the nodes, a slab of ``size`` each, and the distances beyond which there may be more."""
    firsts, head, weight = steps
    dist, last = np.full(len(nodes) * size, np.inf), np.empty(len(nodes) * size, np.int32)
    reach = np.full(len(nodes), np.inf)
    at = np.arange(len(nodes)) * size + nodes
    dist[at] = 0.0
    far, seen, wide = at, [at], room / 4
    edge = 0.0
    while len(far):
        edge = max(edge + wide, float(dist[far].min()))
        close = dist[far] <= edge
        at, later = far[close], [far[~close]]
        while len(at):
            at = _once(at, last)
            which = at // size
            node = at - which * size
            end = _upto(firsts, weight, node, room - dist[at])
            over = np.flatnonzero(end < firsts[node + 1])
            np.minimum.at(reach, which[over], dist[at[over]] + weight[end[over]])
            row, k = _spread(firsts[node], end - firsts[node])
            to, new = (at - node)[row] + head[k], dist[at][row] + weight[k]
            fell = np.flatnonzero(new < dist[to])
            to, new = to[fell], new[fell]
            np.minimum.at(dist, to, new)
            seen.append(to)
            close = new <= edge
            later.append(to[~close])
            at = to[close]
        far = np.concatenate(later)
        far = _once(far[dist[far] > edge], last) if len(far) else far
        wide *= 1.5
    slots = np.unique(np.concatenate(seen))
    return slots, dist[slots], reach


def prepared(demand: DataFrame, graph: Adjacency, cost: np.ndarray) -> Broadcast | None:
    """The core with its balls, made by tasks, broadcast; None of a network or a number of sources too small for it to pay."""
    if len(graph.names) < LEAST_CORE:
        return None
    core = Core(graph, cost)
    if core.size < LEAST_CORE or not len(core.head):
        return None
    few = -(-core.size // CORE_A_SOURCE)
    if demand.select("source").distinct().limit(few).count() < few:
        return None
    steps = core.upstream()
    room = 1.2 * core.pilot(steps, core.ball)
    core.radius = core.pilot((core.firsts, core.head, core.weight), SETTLED)
    spark = demand.sparkSession
    context = spark.sparkContext
    sent = context.broadcast(core)
    rows = max(1, LABELS // core.size)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, steps = sent.value, None
        for batch in batches:
            steps = steps or core.upstream()
            nodes = batch["id"].to_numpy()
            for i in range(0, len(nodes), rows):
                yield core.balls(nodes[i : i + rows], steps, room)

    found = cut(spark.range(0, core.size, 1, max(2 * context.defaultParallelism, 1)).mapInArrow(made, "node long, near array<int>, span array<float>, reach double"))
    core.hold(found.toArrow())
    sent.destroy()
    drop(found)
    return context.broadcast(core)


class Corridor(Forest):
    """The distances of trips from several sources (places) to their targets, and trees of shortest paths to these.

    A slot is a node's place in a slab of all nodes; of the core's nodes off every shortest
    path to a target, some have no distance or too long a one.  Without ``trees`` none are grown.
    """

    def __init__(self, graph: Adjacency, sources: np.ndarray, cost: np.ndarray, core: Core, which: np.ndarray, target: np.ndarray, trees: bool = True):
        self.graph, self.sources, self.cost, self.core = graph, sources, cost, core
        self.into, self.before = graph.slabs[3], graph.slabs[4]
        self.start = np.arange(len(sources)) * len(graph.names) + sources
        self.heap, self.trees = None, trees
        self._search(which, target)

    def slot(self, source: np.ndarray, node: np.ndarray) -> np.ndarray:
        return source * len(self.graph.names) + node

    def _entries(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, position) of the links into each node."""
        row, k = _spread(self.before[node], self.before[node + 1] - self.before[node])
        return row, self.into[k]

    def distances(self, at: np.ndarray) -> np.ndarray:
        n, place = len(self.graph.names), self.core.place
        which = np.maximum(at, 0) // n
        node = np.maximum(at, 0) - which * n
        out = self.dist[which * self.core.size + np.maximum(place[node], 0)]
        rest = np.flatnonzero(place[node] < 0)
        row, k = self._entries(node[rest])
        left = np.full(len(rest), np.inf)
        if len(k):
            near = place[self.graph.tail[k]]
            inner = np.flatnonzero(near >= 0)
            row, k = row[inner], k[inner]
            np.minimum.at(left, row, self.dist[which[rest][row] * self.core.size + near[inner]] + self.cost[k])
            own = self.graph.tail[k] == self.sources[which[rest][row]]
            np.minimum.at(left, row[own], self.cost[k[own]])
        out[rest] = left
        out[node == self.sources[which]] = 0.0
        out[at < 0] = np.inf
        return out

    def _settle(self, far: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Settle all up to the limits of their sources; what is labelled beyond is returned."""
        core, dist, done, last, size = self.core, self.dist, self.done, self.last, self.core.size
        wide = core.radius / 6
        while True:
            far = far[dist[far] < done[far]]
            here = dist[far] <= limit[far // size]
            if not here.any():
                return far
            edge = float(dist[far][here].min()) + wide
            here &= dist[far] <= edge
            at, later = far[here], [far[~here]]
            while len(at):
                at = _once(at, last)
                d = dist[at]
                done[at] = d
                node = at % size
                row, k = _spread(core.firsts[node], core.firsts[node + 1] - core.firsts[node])
                to, new = self._sent(at - node, d, row, k)
                close = new <= np.minimum(edge, limit[to // size])
                later.append(to[~close])
                at = to[close]
                at = at[dist[at] < done[at]]
            far = np.concatenate(later)
            wide *= 1.2  # few rounds however far apart distances are

    def _sent(self, slab: np.ndarray, d: np.ndarray, row: np.ndarray, k: np.ndarray, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The labels that fell where steps ``k`` lead from distances ``d``."""
        core, dist, step = self.core, self.dist, self.step
        to, new = slab[row] + core.head[k], (d[row] + core.one[k]) + core.two[k]
        there = dist[to]
        if step is None:
            fell = np.flatnonzero(new < there if most is None else (new < there) & (new <= most[to]))
            to, new = to[fell], new[fell]
            np.minimum.at(dist, to, new)
            return to, new
        met = np.flatnonzero(new <= there)
        if most is not None:
            met = met[new[met] <= most[to[met]]]
        to, new, k, fell = to[met], new[met], k[met], new[met] < there[met]
        step[to[~fell]] = -1
        to, new, k = to[fell], new[fell], k[fell]
        np.minimum.at(dist, to, new)
        won = np.flatnonzero(new == dist[to])
        step[to[won]] = k[won]
        step[to[won][step[to[won]] != k[won]]] = -1
        return to, new

    def _search(self, which: np.ndarray, target: np.ndarray) -> None:
        core, graph, size = self.core, self.graph, self.core.size
        number = len(self.sources)
        self.dist = dist = np.full(number * size, np.inf)
        self.done, self.last = np.full(number * size, np.inf), np.empty(number * size, np.int32)
        # The step to each label, -1 of those that two steps share or none leads to.
        self.step = np.full(number * size, -1, np.int32) if self.trees else None
        place = core.place[self.sources]
        held = np.flatnonzero(place >= 0)
        slots = [held * size + place[held]]
        dist[slots[0]] = 0.0
        outer = np.flatnonzero(place < 0)
        row, k = _spread(graph.firsts[self.sources[outer]], graph.firsts[self.sources[outer] + 1] - graph.firsts[self.sources[outer]])
        other = graph.heads[k] != self.sources[outer][row]
        slots.append(outer[row[other]] * size + core.place[graph.heads[k[other]]])
        np.minimum.at(dist, slots[1], self.cost[k[other]])
        # A target's ends: itself in the core, or the nodes before it, each with a last cost.
        place = core.place[target]
        held, outer = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        row, k = self._entries(target[outer])
        near = core.place[graph.tail[k]]
        inner = near >= 0
        row, k, near = row[inner], k[inner], near[inner]
        trip = np.concatenate([held, outer[row]])
        end, last_cost = np.concatenate([place[held], near]).astype(np.int64), np.concatenate([np.zeros(len(held)), self.cost[k]])
        slab = which[trip] * size
        limit = np.full(number, core.radius)
        far = self._settle(_once(np.concatenate(slots), self.last), limit)
        # Bounds of the ends' distances by what both sides have met, as long as nearer ones may be further up.
        best, least = np.full(len(end), np.inf), np.full(len(target), np.inf)
        i, asked = 0, np.arange(len(end))
        while len(asked) and i < core.ball:
            j = min(core.ball, max(2 * i, 32))
            for part in np.array_split(asked, -(-len(asked) // 4096)):
                met = dist[slab[part, None] + core.near[end[part], i:j]] + core.span[end[part], i:j]
                best[part] = np.minimum(best[part], met.min(axis=1))
            np.minimum.at(least, trip[asked], best[asked] + last_cost[asked])
            cap = np.minimum(best, least[trip] - last_cost)
            asked = asked[core.span[end[asked], j - 1] <= (cap * (1 + SLACK) - limit[slab // size])[asked]]
            asked = asked[np.isfinite(core.span[end[asked], j - 1])]
            i = j
        # A cap allows for the rounding of the whole trip's sum, so that equally short ones stay.
        cap = np.minimum(best, least[trip] - last_cost) + SLACK * np.minimum(least[trip], best + last_cost)
        part = np.flatnonzero(np.isfinite(core.reach[end]))
        np.maximum.at(limit, slab[part] // size, cap[part] - core.reach[end[part]])
        far = self._settle(far, limit)
        # How long a label still serves some target.
        most = np.full(number * size, -np.inf)
        on, i = np.flatnonzero(np.isfinite(cap) & (cap > limit[slab // size])), 0
        while len(on) and i < core.ball:
            j = min(core.ball, i + 32)
            left = cap[on, None] - core.span[end[on], i:j]
            open_ = left >= limit[slab[on] // size][:, None]
            np.maximum.at(most, (slab[on, None] + core.near[end[on], i:j])[open_], left[open_])
            on, i = on[open_[:, -1]], j
        top = most.reshape(number, size).max(axis=1)
        at = far[(dist[far] <= most[far]) & (dist[far] < self.done[far])]
        at = _once(at, self.last)
        while len(at):
            d = dist[at]
            which_, node = at // size, at % size
            ends = _upto(core.firsts, core.weight, node, top[which_] - d)
            row, k = _spread(core.firsts[node], ends - core.firsts[node])
            to, _ = self._sent(at - node, d, row, k, most)
            at = _once(to, self.last)
        del self.done, self.last

    def grow(self, at: np.ndarray, node: np.ndarray) -> None:
        if not self._grown(at, node):
            self.heap = Forest(self.graph, self.sources, self.cost)
            self.heap.grow(self._known(at), node)
            self.link, self.up = self.heap.link, self.heap.up

    def _known(self, at: np.ndarray) -> np.ndarray:
        n = len(self.graph.names)
        return self.heap.slot(at // n, at % n)

    def rows(self, at: np.ndarray) -> np.ndarray:
        if self.heap is not None:
            return self.heap.rows(self._known(at))
        if not len(self.held):
            return np.full(len(at), -1)
        k = np.minimum(np.searchsorted(self.held, at), len(self.held) - 1)
        return np.where(self.held[k] == at, k, -1)

    def _grown(self, at: np.ndarray, node: np.ndarray) -> bool:
        graph = self.graph
        self.held = np.zeros(0, np.int64)
        keys, links, ups = [self.held], [self.held], [self.held]
        while True:
            at, first = np.unique(at, return_index=True)
            new = (self.rows(at) < 0) & ~np.isin(at, self.start)
            at, node = at[new], node[first][new]
            if not len(at):
                break
            keys.append(at)
            self.held = np.sort(np.concatenate([self.held, at]))
            slab = at - node
            place = self.core.place[node]
            step = self.step[slab // len(graph.names) * self.core.size + np.maximum(place, 0)]
            known = np.flatnonzero((place >= 0) & (step >= 0) & (self.core.weight[step] > 0))
            link = np.full(len(at), -1)
            link[known] = self.core.into[step[known]]
            # Elsewhere all links into a node are looked at, and where a known one has no length a heap must say.
            if (self.cost[link[known]] <= 0).any():
                return False
            rest = np.flatnonzero(link < 0)
            own = self.distances(at[rest])
            row, k = self._entries(node[rest])
            behind = self.distances(slab[rest][row] + graph.tail[k])
            tight = behind + self.cost[k] == own[row]
            if (tight & (behind >= own[row])).any():
                return False
            tight = np.flatnonzero(tight)
            link[rest] = k[tight[np.flatnonzero(np.diff(row[tight], prepend=-1))]]  # the lowest id comes first
            node = graph.tail[link].astype(np.int64)
            at = slab + node
            links.append(link)
            ups.append(at)
        order = np.argsort(np.concatenate(keys))
        self.link = np.concatenate(links)[order]
        self.up = self.rows(np.concatenate(ups)[order])
        return True
