"""Networks as DataFrames: links(link_id, u, v, ...) and nodes(node_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import GraphInfo
from ..scratch import cut
from .components import strong_components


def dense_ids(df: DataFrame, id_col: str, *order: str) -> DataFrame:
    """``df`` with ids 0.. in the order of the given columns, without gathering rows in one task.

    Rows are range-partitioned by the order, numbered within their sorted partition as they are
    written (an id in 33 bits below the partition's) and shifted by the partitions before, of
    which only the counts meet.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33)).withColumn("_own", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = ranged.groupBy("_part").count()
    before = sizes.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return ranged.join(F.broadcast(before), "_part").withColumn(id_col, (F.col("_own") + F.col("_before")).cast("long")).drop("_at", "_part", "_own", "_before")


class DiGraph:
    """A directed multigraph with nodes 0..n-1; a link's id is its position."""

    def __init__(self, links: DataFrame, number_of_nodes: int, name: str = ""):
        self.links_frame, self.number_of_nodes, self.name = links, number_of_nodes, name

    @classmethod
    def from_links(cls, spark: SparkSession, links: list[tuple[int, int]], number_of_nodes: int, name: str = "") -> DiGraph:
        """Of a list of (u, v) in order; duplicates and self-loops are permitted."""
        return cls(spark.createDataFrame([(i, u, v) for i, (u, v) in enumerate(links)], "link_id long, u long, v long"), number_of_nodes, name)

    def add_links_from(self, links: list[tuple[int, int]]) -> DiGraph:
        """A graph with further links, whose ids go on from those here."""
        first = self.links_frame.agg(F.coalesce(F.max("link_id") + 1, F.lit(0))).first()[0]
        more = self.links_frame.sparkSession.createDataFrame([(first + i, u, v) for i, (u, v) in enumerate(links)], "link_id long, u long, v long")
        return DiGraph(self.links_frame.unionByName(more, allowMissingColumns=True), self.number_of_nodes, self.name)

    def append_nodes(self, n: int) -> DiGraph:
        return DiGraph(self.links_frame, self.number_of_nodes + n, self.name)

    def nodes(self) -> DataFrame:
        return self.links_frame.sparkSession.range(self.number_of_nodes).withColumnRenamed("id", "node_id")

    def links(self) -> DataFrame:
        """(link_id, u, v) in order of ids."""
        return self.links_frame.select("link_id", "u", "v").orderBy("link_id")

    def number_of_links(self) -> int:
        return self.links_frame.count()

    def info(self) -> GraphInfo:
        return GraphInfo(self.name, self.number_of_nodes, self.number_of_links())

    def degree_of(self, node: int) -> int:
        return self.links_frame.where((F.col("u") == node) & (F.col("v") != node)).count()


def out_degree(links: DataFrame) -> DataFrame:
    """(node_id, degree) of nodes with outgoing links; self-loops don't count."""
    return links.where("u <> v").groupBy(F.col("u").alias("node_id")).agg(F.count("*").alias("degree"))


def endpoints(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node): the distinct ends of links."""
    return links.select(F.explode(F.array(F.col(u), F.col(v))).alias("node")).distinct()


def node_index(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, node_id): a dense index over the sorted distinct ends."""
    return dense_ids(endpoints(links, u, v), "node_id", "node")


def encode_links(links: DataFrame, index: DataFrame, u: str, v: str) -> DataFrame:
    """``links`` with u and v replaced by the ids of their nodes; links with an unknown end go."""
    a = index.select(F.col("node").alias(u), F.col("node_id").alias("_u"))
    b = index.select(F.col("node").alias(v), F.col("node_id").alias("_v"))
    return links.join(a, u).join(b, v).drop(u, v).withColumnsRenamed({"_u": "u", "_v": "v"})


def last_parallel(links: DataFrame, order: str = "seq") -> DataFrame:
    """One link for each (u, v): the attributes of the last, at the place of the first."""
    rest = [c for c in links.columns if c not in ("u", "v", order)]
    last = F.max_by(F.struct(*rest), order).alias("_last") if rest else F.lit(None).alias("_last")
    out = links.groupBy("u", "v").agg(F.min(order).alias(order), last)
    return out.select("u", "v", order, *(F.col(f"_last.{c}") for c in rest))


def largest_component(links: DataFrame) -> DataFrame:
    """(node, node_id): the nodes of the largest strong component (the smallest name among equals), renumbered in order."""
    parts = cut(strong_components(links))
    best = parts.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    return dense_ids(parts.join(F.broadcast(best.select("component")), "component").select("node"), "node_id", "node")


def within(links: DataFrame, index: DataFrame) -> DataFrame:
    """The links with both ends in the index, renumbered."""
    return encode_links(links, index, "u", "v")


def links_by_zone(zone_links: DataFrame) -> DataFrame:
    """(zone, links): the distinct links (u, v) of each zone, in order."""
    return zone_links.groupBy("zone").agg(F.sort_array(F.collect_set(F.struct("u", "v"))).alias("links"))


def centroids(zone_links: DataFrame, degrees: DataFrame) -> DataFrame:
    """(zone, node_id): the node that all links of a zone share.

    Of several, that of the smallest (out-degree, id); null where the links share none.
    """
    ends = zone_links.select("zone", F.struct("u", "v").alias("link"), F.explode(F.array_distinct(F.array("u", "v"))).alias("node_id"))
    held = ends.groupBy("zone", "node_id").agg(F.count_distinct("link").alias("held"))
    total = zone_links.groupBy("zone").agg(F.count_distinct(F.struct("u", "v")).alias("links"))
    ranked = held.join(total, "zone").where("held = links").join(degrees, "node_id", "left")
    best = ranked.groupBy("zone").agg(F.min(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), "node_id")).alias("best"))
    return total.select("zone").join(best, "zone", "left").select("zone", F.col("best.node_id").alias("node_id"))


def nearest_nodes(points: DataFrame, nodes: DataFrame, cell: float = 0.01, rings: int = 6, slabs: int = 64) -> DataFrame:
    """``points`` (point_id, x, y) with the id of the nearest node (node_id, x, y): the smallest id among equals.

    Equal coordinates are joined first; of nodes, and of points, at one place one looks for all.
    The others look in the grid cells around them, in rings that double until the best
    distance lies within the ring: ``rings`` from ``cell`` on, and smaller ones before where the nodes
    lie so close that a cell holds many.  Points that are still open look among boxes of about
    equally many nodes: ``slabs`` by x, as many by y in each.  Only boxes that may hold the
    nearest node are searched.  Raises without nodes.
    """
    if nodes.isEmpty():
        raise LookupError("there is no node to be near to")
    nodes = cut(nodes.groupBy("x", "y").agg(F.min("node_id").alias("node_id")))
    joined = cut(points.select("point_id", "x", "y").join(nodes, ["x", "y"], "left"))
    sought = joined.where("node_id is null")
    # Points without both coordinates are near to nothing by any distance, and stay apart.
    places = cut(sought.groupBy("x", "y").agg(F.min("point_id").alias("place")))
    done = joined.where("node_id is not null").select("point_id", "node_id")
    found = _near(places.select(F.col("place").alias("point_id"), "x", "y"), nodes, cell, rings, slabs)
    same = F.col("x").eqNullSafe(F.col("_x")) & F.col("y").eqNullSafe(F.col("_y"))
    shared = places.join(found.withColumnRenamed("point_id", "place"), "place").select(F.col("x").alias("_x"), F.col("y").alias("_y"), "node_id")
    done = done.unionByName(sought.drop("node_id").join(shared, same).select("point_id", "node_id"))
    return points.join(done, "point_id")


#: Nodes of a cell, as a node sees it on average, up to which cells aren't made smaller.
CELL_NODES = 8
#: Halvings of cells at most.
HALVINGS = 16


def _halvings(nodes: DataFrame, cell: float) -> int:
    """How often to halve ``cell`` until a node's own cell holds few others on average."""
    for k in range(HALVINGS):
        wide = cell / 2**k
        held = nodes.groupBy(F.floor(F.col("x") / wide), F.floor(F.col("y") / wide)).count()
        row = held.agg(F.sum(F.col("count") * F.col("count")).alias("pairs"), F.sum("count").alias("n")).first()
        if row["pairs"] <= CELL_NODES * row["n"]:
            return k
    return HALVINGS


def _near(points: DataFrame, nodes: DataFrame, cell: float, rings: int, slabs: int) -> DataFrame:
    """(point_id, node_id) of points at different places, none of which is a node's."""
    done, open_ = points.sparkSession.createDataFrame([], "point_id long, node_id long"), points
    halved = _halvings(nodes, cell)
    ring = 0.5**halved
    for _ in range(rings + halved):
        if open_.isEmpty():
            break
        # Cells as wide as the ring keep the look-ups at nine whatever the ring is.
        wide = cell * ring
        gx, gy = F.floor(F.col("x") / wide).cast("long"), F.floor(F.col("y") / wide).cast("long")
        around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
        asked = open_.select("point_id", "x", "y", gx.alias("gx"), gy.alias("gy"), around.alias("a")).select("point_id", "x", "y", (F.col("gx") + F.col("a.i")).alias("gx"), (F.col("gy") + F.col("a.j")).alias("gy"))
        filed = nodes.select("node_id", F.col("x").alias("nx"), F.col("y").alias("ny"), F.floor(F.col("x") / wide).cast("long").alias("gx"), F.floor(F.col("y") / wide).cast("long").alias("gy"))
        best = asked.join(filed, ["gx", "gy"]).groupBy("point_id").agg(F.min(F.struct(_square(), "node_id")).alias("best"))
        sure = cut(best.where(F.col("best.d2") <= F.lit(wide * wide)).select("point_id", "best.node_id"))
        done = done.unionByName(sure)
        open_ = cut(open_.join(sure, "point_id", "left_anti"))
        ring *= 2
    if not open_.isEmpty():
        done = done.unionByName(_by_boxes(open_, nodes, slabs))
    return done


def _square():
    """The square of the distance of (x, y) and (nx, ny)."""
    return (F.pow(F.col("x") - F.col("nx"), F.lit(2.0)) + F.pow(F.col("y") - F.col("ny"), F.lit(2.0))).alias("d2")


def _by_boxes(points: DataFrame, nodes: DataFrame, slabs: int) -> DataFrame:
    """(point_id, node_id) by bounding boxes, at most slabs * slabs of them, which are broadcast."""
    shares = [i / slabs for i in range(1, slabs)]
    at_x = F.array(*map(F.lit, nodes.approxQuantile("x", shares, 0.5 / slabs)))
    above = lambda edges, c: F.size(F.filter(edges, lambda e: e < F.col(c)))
    placed = nodes.select("node_id", F.col("x").alias("nx"), F.col("y").alias("ny"), above(at_x, "x").alias("i"))
    at_y = placed.groupBy("i").agg(F.percentile_approx("ny", shares, 10 * slabs).alias("edges"))
    boxed = cut(placed.join(F.broadcast(at_y), "i").select("node_id", "nx", "ny", (F.col("i") * slabs + above(F.col("edges"), "ny")).alias("box")))
    boxes = boxed.groupBy("box").agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("nx", "ny")))
    boxes = boxes.agg(F.collect_list(F.struct("box", "min_nx", "max_nx", "min_ny", "max_ny")).alias("boxes"))
    zero = F.lit(0.0)

    def nearest(b):
        return F.pow(F.greatest(b.min_nx - F.col("x"), F.col("x") - b.max_nx, zero), F.lit(2.0)) + F.pow(F.greatest(b.min_ny - F.col("y"), F.col("y") - b.max_ny, zero), F.lit(2.0))

    def farthest(b):
        return F.pow(F.greatest(F.abs(F.col("x") - b.min_nx), F.abs(F.col("x") - b.max_nx)), F.lit(2.0)) + F.pow(F.greatest(F.abs(F.col("y") - b.min_ny), F.abs(F.col("y") - b.max_ny)), F.lit(2.0))

    able = points.join(F.broadcast(boxes)).withColumn("most", F.array_min(F.transform("boxes", farthest)))
    asked = able.select("point_id", "x", "y", F.explode(F.transform(F.filter("boxes", lambda b: nearest(b) <= F.col("most") * (1 + 1e-9)), lambda b: b.box)).alias("box"))
    best = asked.join(boxed, "box").groupBy("point_id").agg(F.min(F.struct(_square(), "node_id")).alias("best"))
    return best.select("point_id", "best.node_id")
