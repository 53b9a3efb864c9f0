"""A four-node network whose equilibrium and optimum are known."""

from flowloom.functions.cost import Linear
from flowloom.operators.equilibrium import Problem

LINKS = [(0, 0, 1, 10.0, 0.0), (1, 0, 2, 1.0, 50.0), (2, 1, 2, 1.0, 10.0), (3, 1, 3, 1.0, 50.0), (4, 2, 3, 10.0, 0.0)]


def braess(spark) -> Problem:
    links = spark.createDataFrame(LINKS, "link_id long, u long, v long, coefficient double, constant double")
    demand = spark.createDataFrame([(0, 0, 3, 6.0)], "trip_id long, source long, target long, volume double")
    return Problem(links, demand, Linear(), "braess", 4)


def by_link(frame, column):
    return [r[column] for r in frame.orderBy("link_id").collect()]


def frame_of(spark, rows):
    """Links of (u, v, cost), numbered in their order."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "link_id long, u long, v long, cost double")
