"""Demand between origins and destinations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.roads import nonzero, to_zone
from .graph import dense_ids


class Trips:
    """A list of trips in order; of equal origins and destinations the last counts."""

    def __init__(self, spark: SparkSession, trips: list[tuple[int, int, float]] = ()):
        self._spark, self.trips = spark, list(trips)

    def append(self, source: int, target: int, volume: float) -> None:
        self.trips.append((source, target, float(volume)))

    def frame(self) -> DataFrame:
        rows = [(i, *t) for i, t in enumerate(self.trips)]
        return self._spark.createDataFrame(rows, "seq long, source long, target long, volume double")

    def compile(self) -> DataFrame:
        return compile_demand(self.frame())


def compile_demand(trips: DataFrame) -> DataFrame:
    """(trip_id, source, target, volume) of trips (seq, source, target, volume).

    The volume of the last trip of each pair counts.  Ids follow the first appearance of
    sources and, within a source, that of targets.
    """
    pairs = trips.groupBy("source", "target").agg(F.max_by("volume", "seq").alias("volume"), F.min("seq").alias("_pair"))
    sources = trips.groupBy("source").agg(F.min("seq").alias("_source"))
    return dense_ids(pairs.join(sources, "source"), "trip_id", "_source", "_pair").select("trip_id", "source", "target", "volume")


def info(demand: DataFrame) -> tuple[int, int]:
    """(number of sources, number of trips)."""
    r = demand.agg(F.count_distinct("source").alias("s"), F.count("*").alias("t")).first()
    return r["s"], r["t"]


def targets_by_source(demand: DataFrame) -> DataFrame:
    """(source, number_of_targets, volume)."""
    return demand.groupBy("source").agg(F.count("*").alias("number_of_targets"), F.sum("volume").alias("volume"))


def total(trips: DataFrame) -> DataFrame:
    """(total_demand) of the trips with volume."""
    return trips.where("volume > 0").agg(F.sum("volume").alias("total_demand"))


def index_of(demand: DataFrame, source: int, target: int) -> int | None:
    """The trip of a pair, or None."""
    r = demand.where((F.col("source") == source) & (F.col("target") == target)).select("trip_id").first()
    return r and r[0]


def encode_trips(trips: DataFrame, index: DataFrame, origin: str = "origin", destination: str = "destination") -> DataFrame:
    """Trips by node id (source, target, volume); an end that the index lacks raises."""
    a = index.select(F.col("node").alias(origin), F.col("node_id").alias("source"))
    b = index.select(F.col("node").alias(destination), F.col("node_id").alias("target"))
    joined = trips.join(a, origin, "left").join(b, destination, "left")
    ends = F.when(F.col("source").isNull(), F.col(origin)).when(F.col("target").isNull(), F.col(destination))
    unknown = F.raise_error(F.concat(F.lit("no node is called "), ends.cast("string")))
    known = F.col("source").isNotNull() & F.col("target").isNotNull()
    return joined.select("source", F.when(known, F.col("target")).otherwise(unknown.cast("long")).alias("target"), "volume", *(c for c in trips.columns if c == "seq"))


def matrix_sum(cells: DataFrame) -> DataFrame:
    """(i, j, volume): the sum of all matrices' cells (i, j, value)."""
    return cells.groupBy("i", "j").agg(F.sum("value").alias("volume"))


def matrix_demand(cells: DataFrame) -> DataFrame:
    """(from_zone, to_zone, volume) of the nonzero cells; zones count from 1."""
    return matrix_sum(cells).where(nonzero(F.col("volume"))).select(to_zone(F.col("i")).alias("from_zone"), to_zone(F.col("j")).alias("to_zone"), "volume")


def travel_demand(cells: DataFrame, zones: DataFrame) -> DataFrame:
    """Trips (seq, source, target, volume) between the nodes of zones (zone, node_id).

    Zones without a node, volumes that aren't positive and trips within one node go.
    """
    known = zones.where("node_id is not null")
    a = known.select(F.col("zone").alias("from_zone"), F.col("node_id").alias("source"))
    b = known.select(F.col("zone").alias("to_zone"), F.col("node_id").alias("target"))
    trips = matrix_demand(cells).join(a, "from_zone").join(b, "to_zone").where("volume > 0 and not isnan(volume) and source <> target")
    return dense_ids(trips, "seq", "from_zone", "to_zone").select("seq", "source", "target", "volume")
