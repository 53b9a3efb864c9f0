"""Fixed schemas of networks, demand, paths and input files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


INT, LONG, DOUBLE, STRING = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType()

LINKS = struct(link_id=LONG, u=LONG, v=LONG)
NODES = struct(node_id=LONG)
TRIPS = struct(source=LONG, target=LONG, volume=DOUBLE)
DEMAND = struct(trip_id=LONG, source=LONG, target=LONG, volume=DOUBLE)
PATHS = struct(trip_id=LONG, links=T.ArrayType(LONG))
COO = struct(row=LONG, col=LONG, value=DOUBLE)

TNTP_LINK = struct(
    from_node=INT, to_node=INT, capacity=DOUBLE, length=DOUBLE, free_flow_time=DOUBLE, b=DOUBLE, power=DOUBLE, speed_limit=DOUBLE, toll=DOUBLE, link_type=INT
)
TNTP_TRIP = struct(origin=INT, destination=INT, volume=DOUBLE)
TNTP_SOLUTION = struct(origin=INT, destination=INT, volume=DOUBLE, cost=DOUBLE)

POINT = struct(x=DOUBLE, y=DOUBLE)


@dataclass(frozen=True)
class GraphInfo:
    """Name and size of a network."""

    name: str
    number_of_nodes: int
    number_of_links: int

    def __str__(self) -> str:
        return f"{self.name}: {self.number_of_nodes} nodes, {self.number_of_links} links"
