"""Parts, the overlay's labels and loadings that push volumes down trees."""

import heapq
import random

import pytest

from flowloom.operators import overlay
from flowloom.operators.loading import link_flow, tree_flow
from flowloom.operators.paths import push_volumes, relax, shortest_paths, trip_costs

from .networks import frame_of

SIDE = 10


def random_cost(rng):
    return float(rng.randrange(1, 9))


def grid():
    rng = random.Random(4)
    near = [(i, j, a, b) for i in range(SIDE) for j in range(SIDE) for a, b in ((i + 1, j), (i, j + 1), (i - 1, j), (i, j - 1)) if 0 <= a < SIDE and 0 <= b < SIDE]
    return [(i * SIDE + j, a * SIDE + b, random_cost(rng)) for i, j, a, b in near]


def anywhere():
    rng = random.Random(5)
    return [(rng.randrange(60), rng.randrange(60), random_cost(rng)) for _ in range(180)]


def chain():
    return [(i, i + 1, 1.0) for i in range(800)]


def labels_of(rows, source):
    """{(source, node): (distance, parent link)}, of equal parents the lowest link."""
    out, dist, parent, done, queue = {}, {source: 0.0}, {source: None}, set(), [(0.0, source)]
    for i, (u, v, c) in enumerate(rows):
        out.setdefault(u, []).append((i, v, c))
    while queue:
        d, u = heapq.heappop(queue)
        if u in done:
            continue
        done.add(u)
        for i, v, c in out.get(u, []):
            if v not in done and (v not in dist or d + c < dist[v]):
                dist[v], parent[v] = d + c, i
                heapq.heappush(queue, (d + c, v))
            elif v not in done and d + c == dist[v]:
                parent[v] = min(parent[v], i)
    return {(source, v): (dist[v], parent[v]) for v in dist}


@pytest.mark.parametrize(("rows", "most", "rounds"), [(grid(), 90, 30), (anywhere(), 40, 30), (chain(), 200, 30), (grid(), 10**6, 0)])
def test_overlay_labels(spark, rows, most, rounds):
    """A chain of 800 links and a grid take tens of rounds, not a round a link; source 10 ** 9 isn't in the network."""
    seen, sources = [], [0, 5, 10**9]
    got = overlay.overlay_labels(frame_of(spark, rows), spark.createDataFrame([(s,) for s in sources], "source long"), most, seen)
    expected = {}
    for s in sources:
        expected |= labels_of(rows, s)
    assert {(r["source"], r["node"]): (r["dist"], r["link_id"]) for r in got.collect()} == expected
    assert len(seen) <= rounds


def test_parts_are_bounded_and_cover_all_nodes(spark):
    rows = grid() + [(1000, i, 1.0) for i in range(0, 95, 2)]  # a node with more links than a part
    parts = {r["node"]: r["part"] for r in overlay.cut_parts(frame_of(spark, rows), 40).collect()}
    assert set(parts) == {x for u, v, _ in rows for x in (u, v)}
    sizes = {}
    for u, _, _ in rows:
        sizes[parts[u]] = sizes.get(parts[u], 0) + 1
    assert sizes.pop(parts[1000]) == 48
    assert max(sizes.values()) <= 80 and len(set(parts.values())) < 60


@pytest.fixture(scope="module")
def town(spark):
    rng = random.Random(7)
    links = frame_of(spark, grid()).persist()
    trips = [(i, rng.randrange(SIDE * SIDE), rng.choice([rng.randrange(SIDE * SIDE), 10**7]), float(rng.randrange(1, 5))) for i in range(150)]
    return links, spark.createDataFrame(trips, "trip_id long, source long, target long, volume double").persist()


@pytest.mark.parametrize("strategy", ["search", "relax"])
def test_tree_flow_is_that_of_the_paths(spark, town, strategy):
    """Trips to oneself, to nowhere and several of one pair are among them."""
    links, demand = town
    paths = shortest_paths(links, demand, strategy="search").persist()
    flow, sums = tree_flow(links, demand, strategy=strategy)
    assert sorted(map(tuple, flow.collect())) == sorted(map(tuple, link_flow(paths, links).collect()))
    expected = [(r["volume"], r["cost"]) for r in paths.collect()]
    assert tuple(sums.first()) == (sum(v * c for v, c in expected if c is not None), sum(v for v, _ in expected))
    costs = trip_costs(links, demand, strategy=strategy)
    assert {(r["trip_id"], r["cost"]) for r in costs.collect()} == {(r["trip_id"], r["cost"]) for r in paths.collect()}
    assert "array" not in str(flow._jdf.queryExecution().optimizedPlan()).lower()


def test_volumes_run_down_a_long_chain(spark):
    """Ways are doubled, so 800 links take ten rounds or so; every node is a target."""
    links = frame_of(spark, chain()[:100])
    labels = relax(links, spark.createDataFrame([(90,)], "source long"))
    demand = spark.createDataFrame([(i, 90, i, 1.0) for i in range(90, 101)], "trip_id long, source long, target long, volume double")
    assert sorted(map(tuple, push_volumes(labels, links, demand).collect())) == [(90 + i, 10.0 - i) for i in range(10)]


def test_empty_demand_loads_nothing(spark, town):
    links, demand = town
    for strategy in ("search", "relax"):
        flow, sums = tree_flow(links, demand.limit(0), strategy=strategy)
        assert {r["flow"] for r in flow.collect()} == {0.0}
        assert not (sums.first()["volume"] or 0.0)
