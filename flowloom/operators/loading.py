"""All-or-nothing loading: every trip's volume on its best path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cost import LinkCost
from ..scratch import cut
from .paths import LINK_SUMS, MAX_BROADCAST_LINKS, by_source, held_network, link_sums, load_batches, load_trips, push_volumes, sent, shortest_paths, tree_labels, with_costs
from .whole import by_components, left_over


def link_flow(trip_paths: DataFrame, links: DataFrame) -> DataFrame:
    """(link_id, flow) of all links: the summed volumes of the paths over each, 0.0 elsewhere."""
    used = trip_paths.select(F.explode("links").alias("link_id"), "volume").groupBy("link_id").agg(F.sum("volume").alias("flow"))
    return links.select("link_id").join(used, "link_id", "left").select("link_id", F.coalesce("flow", F.lit(0.0)).alias("flow"))


def tree_flow(links: DataFrame, demand: DataFrame, max_links: int = MAX_BROADCAST_LINKS, strategy: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(flow, sums): every trip's volume on its best path at the links' ``cost``, without making a path.

    ``flow`` is (link_id, flow) of all links, ``sums`` one row of the trips' best travel time
    and volume.  Each source's volumes run down its tree of shortest paths, in a task where the
    network is broadcast or the source's component fits in one (:mod:`.whole`), else in joins.  Of equally short paths the same ones count as
    in :func:`.paths.shortest_paths`; unreachable trips load nothing.
    """
    held = held_network(links, max_links, strategy)
    if held is not None:
        found = cut(load_trips(by_source(demand), *sent(demand, *held)))
        rest = None
    else:
        found, rest = by_components(links, demand, load_batches, LINK_SUMS)
        over = left_over(*rest) if rest is not None else None
        if over is not None:
            found, rest = found.unionByName(load_trips(by_source(rest[1]), *over).select(*found.columns)), None
        found = cut(link_sums(found))
    used, sums = found.where("link_id is not null").select("link_id", "flow"), found.select("best", "volume")
    if rest is not None:
        over, trips = rest
        labels = cut(tree_labels(over, trips.select("source").distinct()))
        used = used.unionByName(push_volumes(labels, over, trips))
        sums = sums.unionByName(with_costs(trips, labels).select((F.col("volume") * F.col("cost")).alias("best"), "volume"))
    sums = sums.agg(F.sum("best").alias("best"), F.sum("volume").alias("volume"))
    flow = links.select("link_id").join(used, "link_id", "left").select("link_id", F.coalesce("flow", F.lit(0.0)).alias("flow"))
    return flow, sums


def load_network(links: DataFrame, cost: LinkCost, demand: DataFrame, flow: str | None = None, strategy: str = "auto", strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(flow, paths, best path cost) at the costs of ``flow`` (a column of links; without one, of no flow).

    Unreachable trips load nothing; their cost is null, or -1.0 with ``strict``.
    """
    volume = F.col(flow) if flow else F.lit(0.0)
    costed = links.withColumn("cost", cost.cost(volume))
    found = shortest_paths(costed, demand, strategy=strategy)
    best = F.coalesce("cost", F.lit(-1.0)) if strict else F.col("cost")
    return link_flow(found, links), found.select("trip_id", "links"), found.select("trip_id", best.alias("cost"))
