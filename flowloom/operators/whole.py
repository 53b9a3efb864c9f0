"""Networks side by side: weak components small enough for a task are searched whole.

No way leaves a weak component, so one that a task can hold needs no borders, overlay or
labels in joins: a task has it and some of its sources, and hands on sums, costs or paths.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..scratch import cut, drop
from .paths import Adjacency, adjacency, sent, weak_components

#: Links of a component that one task holds (some 100 bytes each), and those that one task joins at last.
WHOLE_LINKS = 1_000_000
#: What is left over is broadcast up to so many times these links.
LEFT = 4
#: Links that components share a task up to, about.
BIN_LINKS = 100_000
#: Sources and trips that meet a component in one task, about.
SOURCES, TRIPS = 256, 65_536


def weak(links: DataFrame, most: int) -> DataFrame:
    """(node, component) of the ends of ``links`` (u, v), taken both ways; a component is named by one of its nodes.

    While over ``most`` pairs are left, every node draws a lot and joins its neighbour of the
    least one, if that is less than its own, and the one which that joined; the pairs of what has
    been joined go on.  The rest are joined in one task.
    """
    nodes = links.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("component", F.col("node"))
    pairs = cut(links.select("u", "v").where("u <> v").distinct())
    moves, k = [], 0
    while pairs.count() > most:
        k += 1
        lot = lambda c: F.xxhash64(F.col(c), F.lit(k))  # noqa: B023, E731
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("node")).agg(F.min(F.struct(lot("v").alias("lot"), F.col("v").alias("to"))).alias("w"))
        joins = cut(least.where(F.col("w.lot") < lot("node")).select("node", F.col("w.to").alias("to")))
        further = joins.select(F.col("node").alias("to"), F.col("to").alias("_to"))
        moves.append(cut(joins.join(further, "to", "left").select("node", F.coalesce("_to", "to").alias("to"))))
        a, b = (moves[-1].select(F.col("node").alias(c), F.col("to").alias(f"_{c}")) for c in ("u", "v"))
        moved = pairs.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v"))
        moved = cut(moved.where("u <> v").distinct())
        drop(pairs, joins)
        pairs = moved

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b["u"].to_numpy(), b["v"].to_numpy()) for b in batches]
        if held:
            names, ends = np.unique(np.concatenate([x for side in zip(*held) for x in side]), return_inverse=True)
            label = weak_components(len(names), *np.split(ends, 2))
            yield pa.RecordBatch.from_pydict({"node": names, "to": names[label]})

    moves.append(pairs.coalesce(1).mapInArrow(joined, "node long, to long"))
    for m in moves:
        nodes = nodes.join(m.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    out = cut(nodes)
    drop(pairs, *moves)
    return out


def bins(links: DataFrame, most: int) -> DataFrame:
    """(node, bin): for the nodes of components of at most ``most`` links the number of the task that holds them, else null."""
    names = weak(links, most)
    sizes = cut(links.select(F.col("u").alias("node")).join(names, "node").groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") <= most))
    tasks = -(-(sizes.agg(F.sum("n")).first()[0] or 1) // BIN_LINKS)
    number = F.pmod(F.xxhash64("component"), F.lit(tasks)).cast("int")
    out = cut(names.join(sizes, "component", "left").select("node", F.when(F.col("n").isNotNull(), number).alias("bin")))
    drop(names, sizes)
    return out


Work = Callable[[Iterator[pa.RecordBatch], Adjacency, np.ndarray], Iterator[pa.RecordBatch]]


def by_components(links: DataFrame, demand: DataFrame, work: Work, schema: str, most: int | None = None) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """What ``work`` makes of trips (in order of their sources) and the components that hold these, and the links and trips left over.

    Components of over ``most`` links are left over, with the trips from them; trips from
    nodes without links are not.  Hot sources are spread by trip.
    """
    nodes = bins(links, WHOLE_LINKS if most is None else most)
    at = nodes.select(F.col("node").alias("source"), "bin", F.lit(True).alias("known"))
    columns = [c for c in ("trip_id", "source", "target", "volume") if c in demand.columns]
    trips = demand.select(*columns).withColumn("volume", F.col("volume").cast("double"))
    trips = cut(trips.join(at, "source", "left").select(*columns, F.when(F.col("known").isNull(), 0).otherwise(F.col("bin")).alias("bin")))
    salt = F.floor(F.col("trip_id") / TRIPS)  # trips of a source are numbered together
    counts = trips.where("bin is not null").groupBy("bin", "source").agg(F.count("*").alias("n")).groupBy("bin").agg(F.count("*").alias("sources"), F.sum("n").alias("trips"))
    shares = cut(counts.select("bin", F.greatest(F.ceil(F.col("sources") / SOURCES), F.ceil(F.col("trips") / TRIPS)).cast("int").alias("shares")))
    tasks = max(1, min(shares.agg(F.sum("shares")).first()[0] or 1, 10_000))
    spread = links.select("link_id", "u", "v", F.col("cost").cast("double").alias("cost")).join(nodes.withColumnRenamed("node", "u"), "u").join(F.broadcast(shares), "bin")
    spread = spread.select("link_id", "u", "v", "cost", "bin", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")).repartition(tasks, "bin", "share")
    own = trips.join(F.broadcast(shares), "bin").select(*columns, "bin", F.pmod(F.xxhash64("source", salt), F.col("shares")).cast("int").alias("share")).repartition(tasks, "bin", "share")

    def run(near: pa.Table, trips_: pa.Table) -> pa.Table:
        graph = Adjacency(*(near[c].to_numpy() for c in ("link_id", "u", "v")))
        made = list(work(trips_.select(columns).sort_by("source").to_batches(), graph, near["cost"].to_numpy()[graph.order]))
        return pa.Table.from_batches(made) if made else none.empty_table()

    none = to_arrow_schema(StructType.fromDDL(schema))
    found = cut(spread.groupBy("bin", "share").cogroup(own.groupBy("bin", "share")).applyInArrow(run, schema))
    over = nodes.where("bin is null")
    if over.isEmpty():
        return found, None
    rest = cut(links.join(over.select(F.col("node").alias("u")), "u", "left_semi"))
    return found, (rest, trips.where("bin is null").drop("bin"))


def left_over(links: DataFrame, demand: DataFrame) -> tuple | None:
    """What a search of the trips left over takes (:func:`.paths.sent`) if their links can be broadcast, else None."""
    held = adjacency(links.select("link_id", "u", "v", "cost"), LEFT * WHOLE_LINKS)
    return held and sent(demand, *held)
