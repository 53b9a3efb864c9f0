"""Searches of several sources at once against the heap's."""

import numpy as np
import pytest

from flowloom.operators import paths
from flowloom.operators.paths import Adjacency, Forest


def trees(graph, cost, sources):
    """By source and node (distance, path) from the heap."""
    out = {}
    for s in sources:
        dist, parent, reached = graph.search(s, cost.tolist())
        for i in reached:
            t = int(graph.names[i])
            out[s, t] = dist[i], graph.link_id[graph.path(s, t, parent)].tolist()
    return out


@pytest.mark.parametrize("patience", [40, 0])
@pytest.mark.parametrize("costs", ["any", "ties", "none"])
def test_forest_meets_the_heap(costs, patience, monkeypatch):
    monkeypatch.setattr(paths, "PATIENCE", patience)
    rng = np.random.default_rng(7)
    for case in range(20):
        n, m = int(rng.integers(2, 40)), int(rng.integers(1, 120))
        u, v = rng.integers(0, n, m) * 3, rng.integers(0, n, m) * 3
        far = (u >= 60).astype(int) * 1000  # often more than one component
        ids = rng.permutation(m) * 2
        graph = Adjacency(ids, u + far, v + far)
        price = {"any": rng.random(m) + 0.1, "ties": rng.integers(1, 4, m).astype(float), "none": rng.integers(0, 2, m).astype(float)}[costs]
        cost = price[graph.order]
        sources = np.unique(graph.names[rng.integers(0, len(graph.names), 5)])
        forest = Forest(graph, graph.places(sources), cost)
        which, node = (x.ravel() for x in np.meshgrid(np.arange(len(sources)), np.arange(len(graph.names))))
        slots = forest.slot(which, node)
        want = trees(graph, cost, sources.tolist())
        there = np.flatnonzero(slots >= 0)
        there = there[np.isfinite(forest.dist[slots[there]])]
        forest.grow(slots[there], node[there])
        ends, links = forest.paths(slots[there])
        got = {}
        for i, k in enumerate(there):
            got[int(sources[which[k]]), int(graph.names[node[k]])] = forest.dist[slots[k]], links[ends[i] : ends[i + 1]].tolist()
        assert got == want
        volume = rng.integers(1, 9, len(there)).astype(float)
        flow, expected = np.zeros(m), dict.fromkeys(ids.tolist(), 0.0)
        forest.push(slots[there], volume, flow)
        for k, x in zip(there, volume):
            for link in want[int(sources[which[k]]), int(graph.names[node[k]])][1]:
                expected[link] += x
        assert dict(zip(graph.link_id.tolist(), flow.tolist())) == expected


def test_searches_reach_no_further_than_their_component():
    """Sixty networks side by side: what a search holds is one of them, however many there are."""
    one = np.array([[0, 1], [1, 2], [2, 0], [2, 3]])
    links = np.concatenate([one + 4 * i for i in range(60)])
    graph = Adjacency(np.arange(len(links)), links[:, 0], links[:, 1])
    forest = Forest(graph, graph.places(np.arange(0, 240, 4)), np.ones(len(links)))
    assert len(forest.dist) == 240
    assert forest.dist.tolist() == [0.0, 1.0, 2.0, 3.0] * 60


def test_a_long_chain_is_searched():
    n = 5000
    graph = Adjacency(np.arange(n), np.arange(n), np.arange(1, n + 1))
    forest = Forest(graph, np.array([0]), np.ones(n))
    at = forest.slot(np.array([0]), np.array([n]))
    forest.grow(at, np.array([n]))
    assert forest.dist[at] == [float(n)]
    assert forest.paths(at)[1].tolist() == list(range(n))
