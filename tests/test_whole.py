"""Components that a task holds, beside those too large for one."""

import random

import numpy as np
import pytest

from flowloom.operators import components, overlay, whole
from flowloom.operators.loading import tree_flow
from flowloom.operators.paths import shortest_paths, trip_costs, weak_components

from .networks import frame_of


def side_by_side():
    """A chain of 60 links, two tangles, a loop and a pair."""
    rng = random.Random(11)
    chain = [(i, i + 1, 1.0) for i in range(60)]
    tangles = [(b + rng.randrange(n), b + rng.randrange(n), float(rng.randrange(1, 9))) for b, n, m in ((100, 20, 60), (200, 9, 18)) for _ in range(m)]
    return [*chain, *tangles, (300, 300, 1.0), (401, 400, 2.0)]


@pytest.mark.parametrize("most", [0, 30, 10**6])
def test_weak_components(spark, most):
    rows = side_by_side()
    names, ends = np.unique([x for u, v, _ in rows for x in (u, v)], return_inverse=True)
    expected = weak_components(len(names), ends[::2], ends[1::2])
    found = {r["node"]: r["component"] for r in whole.weak(frame_of(spark, rows), most).collect()}
    assert set(found) == set(names.tolist())
    together = {}
    for x, i in zip(names.tolist(), expected.tolist()):
        together.setdefault(i, set()).add(found[x])
    assert all(len(s) == 1 for s in together.values()) and len(set().union(*together.values())) == len(together)


@pytest.mark.parametrize("most", [30, 10**6])
def test_components_within_tasks_and_beyond(spark, most, monkeypatch):
    """Trips between components, to and from unknown nodes and to oneself are among them."""
    for name, value in (("WHOLE_LINKS", most), ("BIN_LINKS", 20), ("SOURCES", 4), ("TRIPS", 32)):
        monkeypatch.setattr(whole, name, value)
    rng = random.Random(12)
    rows = side_by_side()
    ends = sorted({x for u, v, _ in rows for x in (u, v)})
    pairs = [(rng.choice(ends), rng.choice(ends)) for _ in range(120)] + [(7, 30)] * 70 + [(999, 5), (5, 999), (999, 999), (40, 40), (300, 300), (400, 401), (401, 400)]
    demand = spark.createDataFrame([(i, s, t, float(rng.randrange(1, 5))) for i, (s, t) in enumerate(pairs)], "trip_id long, source long, target long, volume double").persist()
    links = frame_of(spark, rows).persist()
    found = {s: {tuple(r) if r["links"] is None else (*tuple(r)[:-1], tuple(r["links"])) for r in shortest_paths(links, demand, strategy=s).collect()} for s in ("search", "relax")}
    assert found["relax"] == found["search"] and len(found["search"]) == len(pairs)
    costs = [{tuple(r) for r in trip_costs(links, demand, strategy=s).select("trip_id", "source", "target", "volume", "cost").collect()} for s in ("search", "relax")]
    assert costs[0] == costs[1]
    flows = [(sorted(map(tuple, flow.collect())), tuple(sums.first())) for flow, sums in (tree_flow(links, demand, strategy=s) for s in ("search", "relax"))]
    assert flows[0] == flows[1]


def test_a_component_of_several_parts_is_searched_whole(spark, monkeypatch):
    """Over the parts of a tangle nearly every node is at a border; its labels in joins are what took the time."""
    monkeypatch.setattr(overlay, "overlay_labels", lambda *_: pytest.fail("labels in joins"))
    rng = np.random.default_rng(13)
    n, m = 2000, 2 * overlay.PART_LINKS + 1
    ids = np.arange(m)
    rows = zip(*(x.tolist() for x in (ids, rng.integers(0, n, m), rng.integers(0, n, m), rng.random(m) + 0.1)))
    links = spark.createDataFrame(list(rows), "link_id long, u long, v long, cost double").persist()
    demand = spark.createDataFrame([(i, i % 3, int(t), 1.0) for i, t in enumerate(rng.integers(0, n, 60))], "trip_id long, source long, target long, volume double")
    flows = [sorted(map(tuple, tree_flow(links, demand, strategy=s)[0].collect())) for s in ("search", "relax")]
    assert flows[0] == flows[1]


def test_strong_components_of_several_parts_take_no_levels(spark, monkeypatch):
    """Networks side by side, each of over a part's links, beside a loop: none is cut into parts."""
    monkeypatch.setattr(components, "_solved", lambda *_: pytest.fail("levels of parts"))
    rng = np.random.default_rng(14)
    n, m = 3000, overlay.PART_LINKS + 1
    one = np.stack([rng.integers(0, n, m), rng.integers(0, n, m)], axis=1)
    rows = np.concatenate([one, one + n, [[9 * n, 9 * n]]])
    names, ends = np.unique(rows, return_inverse=True)
    ends = ends.reshape(-1, 2)
    expected = names[components.search(len(names), ends[:, 0], ends[:, 1])]
    found = {r["node"]: r["component"] for r in components.strong_components(spark.createDataFrame(rows.tolist(), "u long, v long")).collect()}
    assert found == dict(zip(names.tolist(), expected.tolist()))


@pytest.mark.parametrize("left", [0, 4])
def test_what_is_left_over_is_broadcast_where_it_can_be(spark, left, monkeypatch):
    """Labels of all sources and nodes in joins are what took the disk."""
    monkeypatch.setattr(whole, "WHOLE_LINKS", 150)
    monkeypatch.setattr(whole, "LEFT", left)
    made, labels = [], overlay.overlay_labels
    monkeypatch.setattr(overlay, "overlay_labels", lambda *a: made.append(1) or labels(*a))
    rng = np.random.default_rng(15)
    rows = [(i, int(u), int(v), float(c)) for i, (u, v, c) in enumerate(zip(rng.integers(0, 50, 200), rng.integers(0, 50, 200), rng.integers(1, 9, 200)))]
    rows += [(200 + i, 100 + i, 101 + i, 1.0) for i in range(10)]
    links = spark.createDataFrame(rows, "link_id long, u long, v long, cost double").persist()
    pairs = [(int(s), int(t)) for s, t in rng.integers(0, 50, (60, 2))] + [(100, 105), (101, 7)]
    demand = spark.createDataFrame([(i, s, t, 1.0 + i % 2) for i, (s, t) in enumerate(pairs)], "trip_id long, source long, target long, volume double").persist()
    for run in (lambda s: shortest_paths(links, demand, strategy=s), lambda s: trip_costs(links, demand, strategy=s), lambda s: tree_flow(links, demand, strategy=s)[0]):
        assert sorted(map(str, run("relax").collect())) == sorted(map(str, run("search").collect()))
    assert bool(made) is (left == 0)
