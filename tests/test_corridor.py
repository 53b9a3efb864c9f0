"""Searches from both ends against the heap's."""

import numpy as np
import pyarrow as pa
import pytest

from flowloom.operators import corridor, paths
from flowloom.operators.corridor import Core, Corridor
from flowloom.operators.equilibrium import FrankWolfeSettings, Problem, solve
from flowloom.functions.cost import Bpr
from flowloom.operators.loading import tree_flow
from flowloom.operators.paths import Adjacency, shortest_paths, trip_costs

from .test_forest import trees


def held(graph, cost, room, radius):
    core = Core(graph, cost)
    core.hold(pa.Table.from_batches([core.balls(np.arange(core.size), core.upstream(), room)]))
    core.radius = radius
    return core


def town(rng, large, small):
    """A few large nodes, each of the small ones between some of them."""
    links = set()
    for x in range(small):
        a = rng.permutation(large)[:3].tolist()
        links |= {(large + x, a[0]), (large + x, a[1]), (a[1], large + x), (a[2], large + x)}
    return np.array(sorted(links))


@pytest.mark.parametrize("costs", ["any", "ties", "tenths", "none"])
@pytest.mark.parametrize("ball", [1, 3, 8])
def test_both_ends_meet_the_heap(costs, ball, monkeypatch):
    monkeypatch.setattr(corridor, "BALL", ball)
    rng = np.random.default_rng(5)
    for case in range(30):
        if case % 2:
            links = town(rng, int(rng.integers(4, 20)), int(rng.integers(10, 80)))
        else:
            links = rng.integers(0, int(rng.integers(2, 40)), (int(rng.integers(1, 120)), 2))
        m = len(links)
        graph = Adjacency(rng.permutation(m) * 2, links[:, 0] * 3, links[:, 1] * 3)
        price = {"any": rng.random(m) + 0.1, "ties": rng.integers(1, 4, m).astype(float), "tenths": rng.integers(1, 9, m) / 10, "none": rng.integers(0, 2, m).astype(float)}[costs]
        cost = price[graph.order]
        core = held(graph, cost, float(rng.random() * 3), float(rng.random() * 2) + 0.01)
        sources = np.unique(graph.names[rng.integers(0, len(graph.names), 5)])
        which, node = (x.ravel() for x in np.meshgrid(np.arange(len(sources)), np.arange(len(graph.names))))
        some = rng.random(len(which)) < rng.random()
        which, node = which[some], node[some]
        found = Corridor(graph, graph.places(sources), cost, core, which, node)
        slots = found.slot(which, node)
        want = trees(graph, cost, sources.tolist())
        there = np.flatnonzero(np.isfinite(found.distances(slots)))
        dist = found.distances(slots)[there]
        found.grow(slots[there], node[there])
        ends, links = found.paths(slots[there])
        got = {(int(sources[which[k]]), int(graph.names[node[k]])): (dist[i], links[ends[i] : ends[i + 1]].tolist()) for i, k in enumerate(there)}
        asked = {(int(sources[w]), int(graph.names[x])) for w, x in zip(which, node)}
        assert got == {k: v for k, v in want.items() if k in asked}
        volume = rng.integers(1, 9, len(there)).astype(float)
        flow, expected = np.zeros(m), dict.fromkeys(graph.link_id.tolist(), 0.0)
        found.push(slots[there], volume, flow)
        for k, x in zip(there, volume):
            for link in want[int(sources[which[k]]), int(graph.names[node[k]])][1]:
                expected[link] += x
        assert dict(zip(graph.link_id.tolist(), flow.tolist())) == expected


def test_a_search_settles_few_nodes_of_a_large_network(monkeypatch):
    """Before, a search settled all nodes of its component."""
    rng = np.random.default_rng(3)
    links = town(rng, 3000, 30_000)
    graph = Adjacency(np.arange(len(links)), links[:, 0], links[:, 1])
    cost = rng.random(len(links))[graph.order]
    core = Core(graph, cost)
    assert core.size <= 3000
    steps = core.upstream()
    room = 1.2 * core.pilot(steps, core.ball)
    core.hold(pa.Table.from_batches([core.balls(np.arange(i, min(i + 100, core.size)), steps, room) for i in range(0, core.size, 100)]))
    core.radius = core.pilot((core.firsts, core.head, core.weight), 100)
    settle, settled = Corridor._settle, []

    def counted(self, far, limit):
        left = settle(self, far, limit)
        settled.append(int(np.isfinite(self.done).sum()))
        return left

    monkeypatch.setattr(Corridor, "_settle", counted)
    target = graph.places(np.arange(3000, 3040))
    found = Corridor(graph, graph.places(np.array([7])), cost, core, np.zeros(40, int), target)
    whole = paths.Forest(graph, graph.places(np.array([7])), cost)
    assert found.distances(found.slot(np.zeros(40, int), target)).tolist() == whole.dist[whole.slot(np.zeros(40, int), target)].tolist()
    assert settled[-1] < core.size / 4


def test_plans_with_both_ends_meet_plain_ones(spark, monkeypatch):
    rng = np.random.default_rng(9)
    links = [(i, int(u), int(v), 5.0, float(c)) for i, ((u, v), c) in enumerate(zip(town(rng, 40, 300), rng.integers(1, 9, 1200) / 10))]
    links = spark.createDataFrame(links, "link_id long, u long, v long, capacity double, free_flow_time double")
    trips = [(i, int(s), int(t), 1.0 + i % 3) for i, (s, t) in enumerate(sorted({(int(s), int(t)) for s, t in rng.integers(0, 340, (900, 2))}))]
    trips = spark.createDataFrame(trips, "trip_id long, source long, target long, volume double")
    costed = links.withColumnRenamed("free_flow_time", "cost")

    def all_plans():
        return [
            sorted(trip_costs(costed, trips).select("trip_id", "cost").collect()),
            sorted(tree_flow(costed, trips)[0].collect()),
            sorted(shortest_paths(costed, trips).select("trip_id", "cost", "links").collect()),
            [(i, round(f, 6)) for i, f, _ in sorted(solve(Problem(links, trips, Bpr(0.15, 4.0)), FrankWolfeSettings(2, 1e-9, 1e-6)).flow.collect())],
        ]

    plain = all_plans()
    made, hold = [], Core.hold
    monkeypatch.setattr(corridor, "LEAST_CORE", 10)
    monkeypatch.setattr(Core, "hold", lambda self, balls: made.append(self.size) or hold(self, balls))
    assert all_plans() == plain
    assert len(made) == 6  # one for each of three plans, and for each of three loadings
