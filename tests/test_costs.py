import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.functions import cost as C
from flowloom.functions import roads, vectors

from .networks import braess, by_link


def test_bpr_at_no_flow_costs_the_free_flow_time(spark):
    links = spark.range(10).select(F.col("id").alias("link_id"), F.lit(1.0).alias("capacity"), F.lit(1.0).alias("free_flow_time"), F.lit(0.0).alias("flow"))
    assert by_link(C.Bpr(1.0, 1.0).with_cost(links), "cost") == [1.0] * 10


@pytest.mark.parametrize("cost", [C.Bpr(0.15, 4.0), C.MarginalBpr(0.15, 4.0), C.Bpr(0.3, 2.5), C.Linear(), C.MarginalLinear()])
def test_expressions_and_arrays_agree(spark, cost):
    values = {"capacity": [3.0, 5.0], "free_flow_time": [2.0, 4.0], "coefficient": [1.0, 2.0], "constant": [5.0, 6.0]}
    flow = [4.0, 0.0]
    frame = spark.createDataFrame([(i, flow[i], *(v[i] for v in values.values())) for i in range(2)], ["link_id", "flow", *values])
    found = by_link(cost.with_cost(frame), "cost")
    assert found == pytest.approx(cost.values(np.array(flow), {k: np.array(v) for k, v in values.items()}).tolist())


def test_total_travel_times_of_equilibrium_and_optimum(spark):
    problem = braess(spark)
    for flows, each in (([4, 2, 2, 2, 4], 92), ([3, 3, 0, 3, 3], 83)):
        flow = spark.createDataFrame([(i, float(x)) for i, x in enumerate(flows)], "link_id long, flow double")
        costed = problem.cost.with_cost(problem.links.join(flow, "link_id"))
        assert costed.agg(vectors.dot(F.col("flow"), F.col("cost"))).first()[0] == each * 6
    assert by_link(costed, "cost") == [30, 53, 10, 53, 30]


def test_registry_and_marginals():
    for cost in (C.Bpr(0.1, 2.0), C.MarginalBpr(), C.Linear("a", "b"), C.MarginalLinear()):
        spec = cost.spec()
        assert C.from_spec({"name": spec["name"].upper(), "kwargs": spec["kwargs"]}) == cost
    assert C.marginal(C.Bpr(0.1, 2.0)) == C.MarginalBpr(0.1, 2.0)
    with pytest.raises(ValueError):
        C.from_spec({"name": "cubic", "kwargs": {}})
    with pytest.raises(ValueError):
        C.marginal(C.MarginalLinear())


def test_capacity_check(spark):
    frame = spark.createDataFrame([(1.0,), (0.0,)], "capacity double")
    with pytest.raises(ValueError):
        C.check_capacity(frame)
    assert C.check_capacity(frame.where("capacity > 0")) == 1.0


def test_road_functions(spark):
    frame = spark.createDataFrame([(0, 50.0, 0.0, 30.0), (1, 12000.0, 2.0, 30.0), (2, None, -1.0, 5.0), (3, 500.0, 4.0, 8.0)], "link_id long, cap double, length double, speed double")
    out = frame.select(
        "link_id",
        roads.capacity(F.col("cap")).alias("cap"),
        roads.is_virtual(roads.capacity(F.col("cap"))).alias("virtual"),
        roads.free_flow_time(F.col("length"), F.col("speed")).alias("t"),
        roads.free_flow_time(F.col("length"), F.col("speed"), corrected=True).alias("right"),
    )
    assert by_link(out, "cap") == [100, 9999, None, 500]
    assert by_link(out, "virtual") == [False, True, None, False]
    assert by_link(out, "t") == [0.0, 15.0, 0.0, 2.0]
    assert by_link(out, "right") == [0.0, 2 / 30, 0.0, 0.5]


def test_vectors(spark):
    v = vectors.of(spark, [3.0, 1.0, 2.0])
    assert vectors.to_list(v) == [3.0, 1.0, 2.0] and vectors.length(v) == 3
    assert vectors.to_list(vectors.zeros(v.select("link_id"))) == [0.0] * 3
    assert v.select(vectors.div(F.col("value"), F.lit(0.0)).alias("x")).first()[0] is None
