import itertools
import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators import components, demand, graph, paths


def rows(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_link_order_is_kept(spark):
    pairs = [(1, 3), (0, 1), (1, 2), (2, 3), (0, 2)]
    g = graph.DiGraph.from_links(spark, pairs, 4, "g")
    assert [(r["u"], r["v"]) for r in g.links().collect()] == pairs
    g = g.add_links_from([(3, 3), (0, 1)]).append_nodes(2)
    assert [(r["u"], r["v"]) for r in g.links().collect()] == [*pairs, (3, 3), (0, 1)]
    assert str(g.info()) == "g: 6 nodes, 7 links"
    assert g.degree_of(3) == 0 and g.degree_of(0) == 3
    assert rows(graph.out_degree(g.links_frame), "node_id", "degree") == [(0, 3), (1, 2), (2, 1)]
    assert g.nodes().count() == 6


def test_dense_ids_follow_the_order(spark):
    values = list(range(500))
    random.Random(1).shuffle(values)
    frame = spark.createDataFrame([(v,) for v in values], "x long").repartition(7)
    assert rows(graph.dense_ids(frame, "id", "x"), "x", "id") == [(i, i) for i in range(500)]
    assert graph.dense_ids(frame.limit(0), "id", "x").count() == 0


def test_node_index(spark):
    links = spark.createDataFrame([(0, 10, 30), (1, 30, 20)], "link_id long, u long, v long")
    index = graph.node_index(links)
    assert rows(index, "node", "node_id") == [(10, 0), (20, 1), (30, 2)]
    assert rows(graph.encode_links(links, index, "u", "v"), "link_id", "u", "v") == [(0, 0, 2), (1, 2, 1)]


def components_by_search(pairs, nodes):
    out = {n: {n} for n in nodes}
    for n in nodes:
        stack = [n]
        while stack:
            x = stack.pop()
            for u, v in pairs:
                if u == x and v not in out[n]:
                    out[n].add(v)
                    stack.append(v)
    return {n: min(m for m in nodes if m in out[n] and n in out[m]) for n in nodes}


@pytest.mark.parametrize("seed", [0, 1])
def test_strong_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(12), rng.randrange(12)) for _ in range(18)]
    nodes = sorted(set(itertools.chain(*pairs)))
    links = spark.createDataFrame([(i, u, v) for i, (u, v) in enumerate(pairs)], "link_id long, u long, v long")
    expected = components_by_search(pairs, nodes)
    assert dict(rows(graph.strong_components(links), "node", "component")) == expected
    sizes = {c: sum(v == c for v in expected.values()) for c in expected.values()}
    best = min(c for c in sizes if sizes[c] == max(sizes.values()))
    assert [r[0] for r in rows(graph.largest_component(links), "node")] == [n for n in nodes if expected[n] == best]


def test_parallel_links_and_centroids(spark):
    links = spark.createDataFrame([(0, 1, 2, "a"), (1, 2, 3, "b"), (2, 1, 2, "c")], "seq long, u long, v long, tag string")
    assert rows(graph.last_parallel(links), "seq", "u", "v", "tag") == [(0, 1, 2, "c"), (1, 2, 3, "b")]
    zones = spark.createDataFrame([(1, 5, 6), (1, 7, 5), (2, 1, 2), (2, 3, 4), (3, 8, 9)], "zone long, u long, v long")
    degrees = spark.createDataFrame([(8, 4), (9, 2)], "node_id long, degree long")
    assert {r["zone"]: r["node_id"] for r in graph.centroids(zones, degrees).collect()} == {1: 5, 2: None, 3: 9}


def test_nearest_nodes(spark):
    rng = random.Random(2)
    nodes = [(i, rng.uniform(0, 10), rng.uniform(0, 10)) for i in range(40)] + [(40, 1000.0, 1000.0)]
    points = [(i, rng.uniform(-20, 30), rng.uniform(-20, 30)) for i in range(40)] + [(40, nodes[3][1], nodes[3][2])]
    found = graph.nearest_nodes(spark.createDataFrame(points, "point_id long, x double, y double"), spark.createDataFrame(nodes, "node_id long, x double, y double"), cell=0.5)
    expected = [(p, min(((x - a) ** 2 + (y - b) ** 2, n) for n, a, b in nodes)[1]) for p, x, y in points]
    assert rows(found, "point_id", "node_id") == expected
    with pytest.raises(LookupError):
        graph.nearest_nodes(spark.createDataFrame(points, "point_id long, x double, y double"), spark.createDataFrame([], "node_id long, x double, y double"))


def test_trips_compile(spark):
    t = demand.Trips(spark)
    for x in ((0, 1, 2.0), (0, 2, 4.0), (1, 2, 3.0)):
        t.append(*x)
    compiled = t.compile()
    assert rows(compiled, "trip_id", "source", "target", "volume") == [(0, 0, 1, 2.0), (1, 0, 2, 4.0), (2, 1, 2, 3.0)]
    assert demand.info(compiled) == (2, 3)
    assert demand.index_of(compiled, 0, 2) == 1 and demand.index_of(compiled, 2, 0) is None
    t = demand.Trips(spark, [(5, 1, 1.0), (2, 1, 7.0), (5, 0, 2.0), (5, 1, 9.0)])
    assert rows(t.compile(), "trip_id", "source", "target", "volume") == [(0, 5, 1, 9.0), (1, 5, 0, 2.0), (2, 2, 1, 7.0)]


def test_unknown_zone_raises(spark):
    index = spark.createDataFrame([(1, 0), (2, 1)], "node long, node_id long")
    good = spark.createDataFrame([(1, 2, 3.0)], "origin long, destination long, volume double")
    assert rows(demand.encode_trips(good, index), "source", "target", "volume") == [(0, 1, 3.0)]
    with pytest.raises(Exception, match="no node is called 9"):
        demand.encode_trips(spark.createDataFrame([(1, 9, 3.0)], "origin long, destination long, volume double"), index).collect()


def test_matrix_demand(spark):
    cells = spark.createDataFrame([(0, 1, 2.0), (0, 1, 3.0), (1, 0, 0.0), (1, 1, float("nan")), (2, 0, -1.0)], "i long, j long, value double")
    found = {(r["from_zone"], r["to_zone"]) for r in demand.matrix_demand(cells).collect()}
    assert found == {(1, 2), (2, 2), (3, 1)}
    zones = spark.createDataFrame([(1, 7), (2, 8), (3, None)], "zone long, node_id long")
    assert rows(demand.travel_demand(cells, zones), "seq", "source", "target", "volume") == [(0, 7, 8, 5.0)]


def test_far_points_and_clustered_nodes(spark):
    """Points far outside, and nodes of which nearly all stand in one place: against every pair."""
    rng = random.Random(3)
    nodes = [(i, rng.gauss(0, 1e-3), rng.gauss(0, 1e-3)) for i in range(300)] + [(300 + i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(40)]
    points = [(i, rng.uniform(-80, 80), rng.uniform(-80, 80)) for i in range(120)] + [(900, 1e7, -1e7), (901, nodes[5][1], nodes[5][2])]
    found = graph.nearest_nodes(spark.createDataFrame(points, "point_id long, x double, y double"), spark.createDataFrame(nodes, "node_id long, x double, y double"), rings=2, slabs=8)
    expected = {p: min(((x - a) ** 2 + (y - b) ** 2, n) for n, a, b in nodes)[1] for p, x, y in points}
    assert {r["point_id"]: r["node_id"] for r in found.collect()} == expected


def test_long_paths_are_walked_back(spark):
    n = 70
    links = spark.createDataFrame([(i, i, i + 1, 1.0) for i in range(n)], "link_id long, u long, v long, cost double")
    demand = spark.createDataFrame([(0, 0, n, 1.0), (1, 3, 20, 1.0), (2, 5, 5, 1.0), (3, 9, 2, 1.0), (4, 8, 9, 1.0)], "trip_id long, source long, target long, volume double")
    sources = spark.createDataFrame([(0,), (3,), (9,), (8,)], "source long")
    labels = sources.join(links.select(F.col("v").alias("node"), "link_id"))
    labels = labels.where("node > source").withColumn("dist", (F.col("node") - F.col("source")).cast("double"))
    found = {r["trip_id"]: r["links"] for r in paths.backtrack(labels, links, demand).collect()}
    assert found == {0: list(range(n)), 1: list(range(3, 20)), 2: [], 3: None, 4: [8]}


def plain_components(links):
    """By who reaches whom."""
    out = {}
    for u, v in links:
        out.setdefault(u, set()).add(v)
        out.setdefault(v, set())

    def reached(x):
        seen, todo = {x}, [x]
        while todo:
            for y in out[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return seen

    reach = {x: reached(x) for x in out}
    return {x: min(y for y in reach[x] if x in reach[y]) for x in out}


@pytest.mark.parametrize("part_links", [60, 10**6])
def test_components_of_chains_circles_and_random_networks(spark, part_links):
    rng = random.Random(31)
    chain = [(i, i + 1) for i in range(60)]
    circle = [(100 + i, 100 + (i + 7) % 40) for i in range(40)]
    mixed = [(200 + rng.randrange(40), 200 + rng.randrange(40)) for _ in range(55)] + [(20, 100), (130, 300), (300, 301), (301, 130), (400, 400)]
    links = chain + circle + mixed
    frame = spark.createDataFrame(links, "u long, v long")
    found = {r["node"]: r["component"] for r in graph.strong_components(frame, part_links=part_links).collect()}
    assert found == plain_components(links)
    assert graph.strong_components(frame.limit(0), part_links=part_links).count() == 0


def grouped(found):
    return {r["node"]: r["component"] for r in found.collect()}


def test_a_long_circle_takes_few_levels(spark):
    """No part of a circle has a circle in it; only the ways through the parts make one."""
    levels = []
    ring = spark.createDataFrame([(i, (i + 1) % 600) for i in range(600)], "u long, v long")
    assert set(grouped(components.strong_components(ring, 200, levels)).values()) == {0}
    assert len(levels) <= 4 and min(levels) > 0


def test_a_deep_grid_without_circles_in_its_parts(spark):
    """Links go right and down alone and around the edges: one component, in rounds of parts, then of pivots."""
    n, levels = 8, []
    links = [(i * n + j, x) for i in range(n) for j in range(n) for x in ((i + 1) % n * n + j, i * n + (j + 1) % n)]
    found = grouped(components.strong_components(spark.createDataFrame(links, "u long, v long"), 60, levels))
    assert set(found.values()) == {0} and len(found) == n * n
    assert len(levels) <= 2 * n + 6


def test_components_that_pass_parts_one_way(spark):
    """Many small parts, some of whose nodes are only entered or only left."""
    rng = random.Random(77)
    links = [(rng.randrange(30), rng.randrange(30)) for _ in range(45)]
    assert grouped(components.strong_components(spark.createDataFrame(links, "u long, v long"), 24)) == plain_components(links)


def test_pivots_alone(spark):
    rng = random.Random(78)
    links = sorted({(u, v) for u, v in ((rng.randrange(25), rng.randrange(25)) for _ in range(45)) if u != v})
    assert grouped(components.by_pivots(spark.createDataFrame(links, "u long, v long"))) == plain_components(links)


def test_nodes_close_together_get_smaller_cells(spark):
    """A cell that holds all nodes is halved, and nodes at one place count once."""
    from flowloom.operators.graph import _halvings

    one = spark.createDataFrame([(i, float(i % 20) / 20, float(i // 20) / 20) for i in range(400)], "node_id long, x double, y double")
    assert _halvings(one, 1.0) >= 2
    copies = one
    for k in range(1, 5):
        copies = copies.unionByName(one.select((F.col("node_id") + 400 * k).alias("node_id"), "x", "y"))
    rng = random.Random(3)
    points = [(i, rng.random() * 1.5, rng.random() * 1.5) for i in range(60)]
    points += [(100 + i, x, y) for i, x, y in points[:20]] + [(200, 0.5, 0.5), (201, None, 0.5)]
    got = {r.point_id: r.node_id for r in graph.nearest_nodes(spark.createDataFrame(points, "point_id long, x double, y double"), copies, cell=1.0).collect()}
    held = [(r.node_id, r.x, r.y) for r in one.collect()]
    want = {i: min(((x - a) ** 2 + (y - b) ** 2, n) for n, a, b in held)[1] for i, x, y in points if x is not None}
    assert got == want


def test_dense_ids_move_no_rows_twice(spark):
    """Rows are numbered as they are written: no window over them, which a few tasks would sort again."""
    frame = spark.createDataFrame([((i * 37) % 101, i % 7) for i in range(300)], "a long, b long")
    found = graph.dense_ids(frame, "n", "a", "b")
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in text
    got = [(r["n"], r["a"], r["b"]) for r in found.orderBy("n").collect()]
    assert got == [(i, *x) for i, x in enumerate(sorted(((j * 37) % 101, j % 7) for j in range(300)))]
