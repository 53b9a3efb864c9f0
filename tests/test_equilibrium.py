import random

import pytest
from pyspark.sql import functions as F

from flowloom.functions.cost import Bpr
from flowloom.operators import pathflow
from flowloom.operators.equilibrium import FrankWolfeSettings, Problem, bisect, line_search, slope_grid, solve, system_optimum
from flowloom.operators.loading import load_network
from flowloom.operators.paths import best_costs, relax, shortest_paths

from .networks import braess, by_link


def test_loading_at_free_flow(spark):
    p = braess(spark)
    flow, paths, best = load_network(p.links, p.cost, p.demand)
    assert by_link(flow, "flow") == [6, 0, 6, 0, 6]
    assert [r["links"] for r in paths.collect()] == [[0, 2, 4]]
    assert best.first()["cost"] == 10


def random_network(spark, seed):
    rng = random.Random(seed)
    links = [(i, rng.randrange(15), rng.randrange(15), float(rng.randint(1, 6))) for i in range(45)]
    demand = [(k, rng.randrange(16), rng.randrange(16), float(rng.randint(1, 9))) for k in range(40)]
    return spark.createDataFrame(links, "link_id long, u long, v long, cost double"), spark.createDataFrame(demand, "trip_id long, source long, target long, volume double")


@pytest.mark.parametrize("seed", [3, 4])
def test_search_and_relaxation_agree(spark, seed):
    links, demand = random_network(spark, seed)
    found = {s: {r["trip_id"]: (r["cost"], r["links"]) for r in shortest_paths(links, demand, strategy=s).collect()} for s in ("search", "relax")}
    assert found["search"] == found["relax"]
    costs = {r["link_id"]: (r["u"], r["v"], r["cost"]) for r in links.collect()}
    for r in demand.collect():
        cost, path = found["search"][r["trip_id"]]
        if path is None:
            assert cost is None
            continue
        at = r["source"]
        for x in path:
            assert costs[x][0] == at
            at = costs[x][1]
        assert at == r["target"] and cost == sum(costs[x][2] for x in path)
    with pytest.raises(ValueError):
        shortest_paths(links, demand, max_links=3, strategy="search")


def test_unreachable_and_own_targets(spark):
    p = braess(spark)
    demand = spark.createDataFrame([(0, 3, 0, 2.0), (1, 1, 1, 5.0), (2, 99, 0, 1.0)], "trip_id long, source long, target long, volume double")
    costed = p.links.withColumn("cost", p.cost.cost(F.lit(0.0)))
    for strategy in ("search", "relax"):
        found = shortest_paths(costed, demand, strategy=strategy)
        assert sorted((r["trip_id"], r["cost"], r["links"]) for r in found.collect()) == [(0, None, None), (1, 0.0, []), (2, None, None)]
    assert {r["trip_id"]: r["cost"] for r in best_costs(found, strict=True).collect()} == {0: -1.0, 1: 0.0, 2: -1.0}
    flow, _, _ = load_network(p.links, p.cost, demand)
    assert by_link(flow, "flow") == [0.0] * 5


def test_relaxation_stops_after_rounds(spark):
    p = braess(spark)
    costed = p.links.withColumn("cost", p.cost.cost(F.lit(0.0)))
    found = relax(costed, p.demand.select("source"), max_rounds=1)
    assert sorted(r["node"] for r in found.collect()) == [0, 1, 2]


def test_user_equilibrium(spark):
    found = solve(braess(spark), FrankWolfeSettings(1000, 1e-6, 1e-6))
    assert by_link(found.flow, "flow") == pytest.approx([4, 2, 2, 2, 4], abs=1e-4)
    assert by_link(found.flow, "cost") == pytest.approx([40, 52, 12, 52, 40], abs=1e-3)
    assert found.gap <= 1e-6 and 20 <= found.iterations <= 200


def test_system_optimum(spark):
    found = system_optimum(braess(spark), FrankWolfeSettings(60, 1e-6, 1e-8))
    assert by_link(found.flow, "flow") == pytest.approx([3, 3, 0, 3, 3], abs=0.2)


def test_frames_and_arrays_agree_and_improve_goes_on(spark):
    p, settings = braess(spark), FrankWolfeSettings(2, 1e-6, 1e-8)
    arrays, frames = solve(p, settings), solve(p, settings, max_links=0)
    assert by_link(arrays.flow, "flow") == pytest.approx(by_link(frames.flow, "flow"), abs=1e-6)
    assert arrays.gap == pytest.approx(frames.gap, abs=1e-6)
    four = solve(p, FrankWolfeSettings(4, 1e-6, 1e-8))
    more = arrays.improve()
    assert more.iterations == 4 and by_link(more.flow, "flow") == pytest.approx(by_link(four.flow, "flow"), abs=1e-9)
    none = solve(p, FrankWolfeSettings(0, 1e-6, 1e-8))
    assert none.iterations == 0 and by_link(none.flow, "flow") == [6, 0, 6, 0, 6] and none.gap == 1 + 1e-6


@pytest.mark.parametrize("beta", [4.0, 2.5])
def test_line_search_meets_direct_bisection(spark, beta):
    rng = random.Random(5)
    rows = [(i, rng.uniform(0, 9), rng.uniform(-5, 5), rng.uniform(1, 9), rng.uniform(1, 4)) for i in range(30)]
    rows = [(i, f, max(d, -f), c, t) for i, f, d, c, t in rows]
    frame = spark.createDataFrame(rows, "link_id long, flow double, direction double, capacity double, free_flow_time double")
    cost = Bpr(0.15, beta)

    def sigma(a):
        return sum(t * (1 + 0.15 * ((f + a * d) / c) ** beta) * d for _, f, d, c, t in rows)

    assert line_search(frame, cost, 1e-6) == pytest.approx(bisect(sigma, 1e-6), abs=1e-5)
    grid = {r["step"]: r["sigma"] for r in slope_grid(frame, cost, [0.25, 0.5]).collect()}
    assert grid[0.25] == pytest.approx(sigma(0.25)) and grid[0.5] == pytest.approx(sigma(0.5))


def test_bisection_ends_above_the_optimum():
    assert bisect(lambda a: 1.0, 1e-6) == pytest.approx(0.0, abs=1e-9)
    assert bisect(lambda a: -1.0, 1e-3) == pytest.approx(1.0, abs=2e-3)


def test_path_flows_solve_the_program(spark, tmp_path):
    p = braess(spark)
    found = solve(p, FrankWolfeSettings(4, 1e-6, 1e-8), keep_paths=True).improve()
    program, values = pathflow.estimate(found)
    assert program.n_constraints() == 6 and program.n_variables() == values.count() == 3
    assert program.residual(values).first()[0] < 1e-9
    assert values.where("flow < 0").count() == 0
    program.write(str(tmp_path / "lp"))
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "lp")).collect())
    assert "Subject To" in text and "c0: " in text and "= 6.0" in text
    numbered = values.select(F.col("col").alias("path_id"), "trip_id", "links")
    assert pathflow.shape(pathflow.link_path(numbered)).first()["nnz"] == 7
    assert pathflow.count_paths(numbered).first()["number_of_paths"] == 3
    with pytest.raises(ValueError):
        pathflow.path_flows(solve(p, FrankWolfeSettings(1, 1e-6, 1e-8)))


def test_duplicate_paths_keep_the_last_trip(spark):
    paths = spark.createDataFrame([(0, [1, 2]), (3, [1, 2]), (1, [2])], "trip_id long, links array<long>")
    assert sorted((r["trip_id"], r["links"]) for r in pathflow.distinct_paths(paths).collect()) == [(1, [2]), (3, [1, 2])]


def test_empty_demand_problem(spark):
    p = braess(spark)
    flow, _, _ = load_network(p.links, p.cost, p.demand.where("volume < 0"))
    assert by_link(flow, "flow") == [0.0] * 5


def test_problem_is_a_record(spark):
    p = braess(spark)
    assert Problem(p.links, p.demand, p.cost).name == ""
