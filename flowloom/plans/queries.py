"""The engine's operators as queries over the network derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import roads, vectors
from ..functions.cost import Bpr, Linear, MarginalBpr, MarginalLinear, check_capacity
from ..operators import demand as trips
from ..operators import graph, pathflow, pathstore
from ..operators.equilibrium import FrankWolfeSettings, Problem, average_excess_cost, slope_grid, solve, sptt, system_optimum, tstt
from ..operators.loading import link_flow, tree_flow
from ..operators.paths import backtrack, relax, shortest_paths, trip_costs
from ..scratch import cut
from ..sources.shapefile import directed_links
from . import testnet

BPR = Bpr(0.15, 4.0)
STEPS = [i / 8 for i in range(9)]
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def link_features(links: DataFrame) -> DataFrame:
    """Links as features of a shapefile: (record, properties, geometry), at points (u, 0), (v, 1) and a bend between."""
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    values = {
        "ID_1": "link_id", "LENGTH": "free_flow_time", "AB_SPEED": F.lit(30), "BA_SPEED": F.lit(20), "AB_CAPACIT": "capacity", "BA_CAPACIT": F.lit(50),
        "AB_ZONE": "u", "BA_ZONE": "v", "AB_LANES": F.lit(1), "BA_LANES": F.col("link_id") % 2, "LAT1": "u", "LON1": F.lit(0), "LAT2": "v", "LON2": F.lit(1),
    }
    properties = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), text(v))))
    point = lambda x, y: F.struct(x.cast("double").alias("x"), F.lit(float(y)).alias("y"))
    return links.select(F.col("link_id").alias("record"), properties.alias("properties"), F.array(point(F.col("u"), 0), point(F.col("link_id"), 2), point(F.col("v"), 1)).alias("geometry"))


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def _flowing(spark: SparkSession, sf: str) -> DataFrame:
    """Links with the orders of their own pair as flow."""
    volumes = testnet.flows(spark, sf).select("u", "v", F.col("orders").cast("double").alias("flow"))
    return testnet.links(spark, sf).join(volumes, ["u", "v"])


def _free(spark: SparkSession, sf: str) -> DataFrame:
    return cut(testnet.links(spark, sf).withColumn("cost", F.col("free_flow_time")))


def _trip_paths(spark: SparkSession, sf: str) -> DataFrame:
    return shortest_paths(_free(spark, sf), cut(testnet.demand(spark, sf)))


def _loaded(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Links with the flow of the free-flow loading and its costs, and the cost of each trip's best path at free flow."""
    links, demand = _free(spark, sf), cut(testnet.demand(spark, sf))
    flow, _ = tree_flow(links, demand)
    found = cut(trip_costs(links, demand))
    return cut(links.drop("cost").join(flow, "link_id").withColumn("cost", BPR.cost(F.col("flow")))), found


def _reachable(found: DataFrame) -> DataFrame:
    return found.where("cost is not null").select("trip_id", "source", "target", "volume")


def problem(spark: SparkSession, sf: str) -> Problem:
    """The derived network with the trips that have a path."""
    links = _free(spark, sf)
    found = trip_costs(links, cut(testnet.demand(spark, sf)))
    return Problem(links.drop("cost"), cut(_reachable(found)), BPR, "nations", 25)


@query
def network_links(spark, sf):
    return testnet.links(spark, sf)


@query
def node_index(spark, sf):
    return graph.node_index(testnet.links(spark, sf))


@query
def link_degree(spark, sf):
    return graph.out_degree(testnet.links(spark, sf))


@query
def graph_info(spark, sf):
    links = testnet.links(spark, sf)
    return links.agg(F.count("*").alias("number_of_links")).join(graph.endpoints(links).agg(F.count("*").alias("number_of_nodes")))


@query
def edge_list(spark, sf):
    return graph.DiGraph(testnet.links(spark, sf), 25).links()


@query
def demand_compile(spark, sf):
    """Trips twice, the second time with another volume: the last counts, the first place stays."""
    base = testnet.demand(spark, sf).select(F.col("trip_id").alias("seq"), "source", "target", "volume")
    again = base.where("volume > 2").select((F.col("seq") + 100_000).alias("seq"), "source", "target", (F.col("volume") * 2).alias("volume"))
    return trips.compile_demand(base.unionByName(again))


@query
def demand_by_source(spark, sf):
    return trips.targets_by_source(testnet.demand(spark, sf))


@query
def demand_info(spark, sf):
    return testnet.demand(spark, sf).agg(F.count_distinct("source").alias("n_sources"), F.count("*").alias("n_trips"))


@query
def total_demand(spark, sf):
    return trips.total(testnet.demand(spark, sf))


def _cells(spark, sf):
    cells = testnet.demand(spark, sf).select(F.col("source").alias("i"), F.col("target").alias("j"), F.col("volume").alias("value"))
    return cells.unionByName(cells.where("value > 1"))


@query
def od_matrix_sum(spark, sf):
    return trips.matrix_demand(_cells(spark, sf))


@query
def od_travel_demand(spark, sf):
    """Zones stand for nations divided by two: two zones share a node, the last have none."""
    zones = spark.range(1, 24).select(F.col("id").alias("zone"), F.when(F.col("id") < 22, F.expr("id div 2")).alias("node_id"))
    return trips.travel_demand(_cells(spark, sf), zones)


def _cost_query(cost, flow="flow"):
    def run(spark, sf):
        links = _flowing(spark, sf).withColumns({"coefficient": F.col("free_flow_time") / 100, "constant": F.col("capacity") / 1000})
        return links.select("link_id", r6(cost.cost(F.col(flow)), "cost"))

    return run


QUERIES["cost_bpr"] = _cost_query(BPR)
QUERIES["cost_marginal_bpr"] = _cost_query(MarginalBpr(0.15, 4.0))
QUERIES["cost_linear"] = _cost_query(Linear())
QUERIES["cost_marginal_linear"] = _cost_query(MarginalLinear())


@query
def minimum_capacity(spark, sf):
    least = check_capacity(testnet.links(spark, sf))
    return spark.range(1).select(F.lit(least).alias("minimum_capacity"), F.lit(least <= 0).alias("bad"))


@query
def capacity_clip(spark, sf):
    return testnet.links(spark, sf).select("link_id", roads.capacity(F.col("capacity")).alias("capacity"))


@query
def virtual_links(spark, sf):
    clipped = roads.capacity(F.col("capacity"))
    return testnet.links(spark, sf).select("link_id", roads.is_virtual(clipped).alias("is_virtual"), roads.is_link(F.col("link_id") % 3).alias("is_link"))


@query
def free_flow_time(spark, sf):
    length = F.col("free_flow_time") * (F.col("link_id") % 4)
    return testnet.links(spark, sf).select("link_id", r6(roads.free_flow_time(length, F.col("capacity")), "speed_by_length"), r6(roads.free_flow_time(length, F.col("capacity"), corrected=True), "length_by_speed"))


@query
def bidirectional_expand(spark, sf):
    """Each link as a feature in both directions, geometry reversed."""
    out = directed_links(link_features(testnet.links(spark, sf)))
    geometry = F.array_join(F.transform("geometry", lambda p: p.x.cast("long").cast("string")), "-")
    return out.select("seq", "id", F.col("from_point.x").cast("long").alias("u"), F.col("to_point.x").cast("long").alias("v"), "speed", F.col("capacity").cast("double").alias("capacity"), "zone", "lanes", geometry.alias("geometry"))


@query
def parallel_links(spark, sf):
    """All flows folded on eight nodes: of parallel links the last counts, at the place of the first."""
    folded = graph.dense_ids(testnet.flows(spark, sf), "seq", "u", "v").select("seq", (F.col("u") % 8).alias("u"), (F.col("v") % 8).alias("v"), "orders")
    return graph.last_parallel(folded)


@query
def zone_grouping(spark, sf):
    """Large links by zone of their start."""
    virtual = testnet.links(spark, sf).where(roads.is_virtual(roads.capacity(F.col("capacity"))) | (F.col("link_id") % 2 == 0))
    by_zone = graph.links_by_zone(virtual.select((F.col("u") % 6).alias("zone"), "u", "v"))
    return by_zone.select("zone", F.array_join(F.transform("links", lambda x: F.format_string("%02d-%02d", x.u, x.v)), ",").alias("links"))


@query
def shortest_distances(spark, sf):
    links = _free(spark, sf)
    found = relax(links, links.select(F.col("u").alias("source")).distinct())
    return found.where("source <> node").select("source", "node", r6(F.col("dist"), "dist"))


@query
def best_path_cost(spark, sf):
    return trip_costs(_free(spark, sf), cut(testnet.demand(spark, sf))).select("trip_id", r6(F.col("cost"), "cost"), r6(F.coalesce("cost", F.lit(-1.0)), "strict_cost"))


@query
def unreachable_trips(spark, sf):
    return _trip_paths(spark, sf).where("links is null").select("trip_id", "source", "target", "volume")


@query
def shortest_paths_edges(spark, sf):
    found = _trip_paths(spark, sf).where("links is not null")
    return found.select("trip_id", F.array_join(F.transform("links", lambda x: x.cast("string")), "-").alias("links"))


@query
def shortest_paths_relaxed(spark, sf):
    """The same by relaxation and backtracking alone."""
    links, demand = _free(spark, sf), cut(testnet.demand(spark, sf))
    found = backtrack(relax(links, demand.select("source").distinct()), links, demand).where("links is not null")
    return found.select("trip_id", F.array_join(F.transform("links", lambda x: x.cast("string")), "-").alias("links"))


@query
def aon_flow(spark, sf):
    return tree_flow(_free(spark, sf), cut(testnet.demand(spark, sf)))[0]


@query
def aon_flow_relaxed(spark, sf):
    """The same with labels and volumes in joins alone."""
    return tree_flow(_free(spark, sf), cut(testnet.demand(spark, sf)), strategy="relax")[0]


@query
def path_dedupe(spark, sf):
    """Paths of trips to odd targets are stored again for another trip, which then counts."""
    found = _trip_paths(spark, sf).where("links is not null").select("trip_id", "target", "links")
    again = found.where("target % 2 = 1").select((F.col("trip_id") + 1000).alias("trip_id"), "links")
    kept = pathflow.distinct_paths(found.select("trip_id", "links").unionByName(again))
    return kept.select("trip_id", F.array_join(F.transform("links", lambda x: x.cast("string")), "-").alias("links"))


@query
def path_counts(spark, sf):
    found = cut(_trip_paths(spark, sf))
    return pathflow.paths_by_source(found.where("links is not null").select("trip_id", "links"), found.select("trip_id", "source"))


@query
def path_keys(spark, sf):
    """The stores' binary keys (links from target to source) in hexadecimal digits, in byte order."""
    found = _trip_paths(spark, sf).where("links is not null")
    keyed = found.select("trip_id", pathstore.key_of(F.col("links")).alias("key"))
    return graph.dense_ids(keyed, "counter", "key").select("counter", "trip_id", F.hex("key").alias("key"))


@query
def total_travel_time(spark, sf):
    links, _ = _loaded(spark, sf)
    return tstt(links).select(F.round("tstt", 2).alias("tstt"))


@query
def shortest_travel_time(spark, sf):
    _, found = _loaded(spark, sf)
    return sptt(_reachable(found), found.select("trip_id", "cost")).select(F.round("sptt", 2).alias("sptt"))


@query
def excess_cost(spark, sf):
    """The average excess cost of the free-flow loading."""
    links, found = _loaded(spark, sf)
    reached = _reachable(found)
    best = trip_costs(links, reached).select("trip_id", "cost")
    return average_excess_cost(links, reached, best).select(F.round("gap", 4).alias("gap"))


@query
def line_search_slopes(spark, sf):
    """The slope along the direction from each link's own orders to the free-flow loading."""
    links, _ = _loaded(spark, sf)
    own = testnet.flows(spark, sf).select("u", "v", F.col("orders").cast("double").alias("own"))
    moving = links.drop("cost").join(own, ["u", "v"]).select("link_id", "capacity", "free_flow_time", F.col("own").alias("flow"), (F.col("flow") - F.col("own")).alias("direction"))
    return slope_grid(moving, BPR, STEPS).select("step", F.round("sigma", 2).alias("sigma"))


@query
def vector_kernels(spark, sf):
    links = _flowing(spark, sf)
    x, y = F.col("flow"), F.col("free_flow_time")
    return links.select(
        "link_id",
        r6(vectors.add(x, y), "added"),
        r6(vectors.sub(x, y), "subtracted"),
        r6(vectors.mul(x, y), "multiplied"),
        r6(vectors.div(x, y), "divided"),
        r6(vectors.scale(x, 0.5), "scaled"),
        r6(vectors.add_constant(x, 1.5), "raised"),
        r6(vectors.power(y, 1.5), "powered"),
    )


@query
def vector_dot(spark, sf):
    return _flowing(spark, sf).agg(F.round(vectors.dot(F.col("flow"), F.col("free_flow_time")), 4).alias("dot"), F.sum("flow").alias("total"))


@query
def solution_error(spark, sf):
    """Flows a hundredth larger than expected ones at BPR costs."""
    expected = BPR.with_cost(_flowing(spark, sf)).select("link_id", "flow", "cost")
    found = expected.withColumns({"flow": F.col("flow") * 1.01})
    out = vectors.error_metrics(found, expected)
    return out.select(r6(F.col("relative_norm"), "relative_norm"), r6(F.col("cost_ratio_excess"), "cost_ratio_excess"))


def _numbered(spark, sf):
    found = _trip_paths(spark, sf).where("links is not null").select("trip_id", "links")
    return cut(pathflow.number_paths(found))


@query
def incidence_trip_path(spark, sf):
    return pathflow.trip_path(_numbered(spark, sf))


@query
def incidence_link_path(spark, sf):
    return pathflow.link_path(_numbered(spark, sf))


@query
def incidence_shape(spark, sf):
    return pathflow.shape(pathflow.link_path(_numbered(spark, sf)))


def _program(spark, sf):
    """The path-flow program of the free-flow loading."""
    links = _free(spark, sf)
    found = cut(shortest_paths(links, cut(testnet.demand(spark, sf))))
    reached = found.where("links is not null")
    return pathflow.path_program(pathflow.number_paths(reached.select("trip_id", "links")), _reachable(found), link_flow(found, links))


@query
def lp_constraints(spark, sf):
    program = _program(spark, sf)
    return program.constraints


@query
def lp_coefficients(spark, sf):
    """The number and sum of coefficients of each row."""
    program = _program(spark, sf)
    return program.coefficients.groupBy("row").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query
def strong_components(spark, sf):
    return graph.strong_components(cut(testnet.links(spark, sf)))


@query
def scc_largest(spark, sf):
    return graph.largest_component(cut(testnet.links(spark, sf)))


@query
def scc_links(spark, sf):
    links = cut(testnet.links(spark, sf))
    return graph.within(links.select("link_id", "u", "v"), graph.largest_component(links)).select("link_id", "u", "v")


@query
def centroid_resolution(spark, sf):
    """Each nation's outgoing links are a zone, every fourth zone also holds a link elsewhere."""
    links = cut(testnet.links(spark, sf))
    zones = links.select(F.col("u").alias("zone"), "u", "v")
    odd = links.where("u % 4 = 0").select(((F.col("u") + 1) % 25).alias("zone"), "u", "v")
    return graph.centroids(zones.unionByName(odd), graph.out_degree(links))


@query
def nearest_node(spark, sf):
    """Customers' balances and keys as points, suppliers as nodes."""
    points = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").cast("long").alias("point_id"), F.col("c_acctbal").cast("double").alias("x"), (F.col("c_custkey") % 100).cast("double").alias("y"))
    nodes = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("node_id"), F.col("s_acctbal").cast("double").alias("x"), (F.col("s_suppkey") % 100).cast("double").alias("y"))
    return graph.nearest_nodes(cut(points), cut(nodes), cell=64.0).select("point_id", "node_id")


SETTINGS = FrankWolfeSettings(10, 1e-4, 1e-6)


def _solved(result) -> DataFrame:
    return result.flow.select("link_id", F.round("flow", 6).alias("flow"), F.round("cost", 6).alias("cost"))


@query
def frank_wolfe_ue(spark, sf):
    return _solved(solve(problem(spark, sf), SETTINGS))


@query
def frank_wolfe_so(spark, sf):
    return _solved(system_optimum(problem(spark, sf), SETTINGS))


@query
def frank_wolfe_improve(spark, sf):
    """Five steps and five more from there."""
    half = FrankWolfeSettings(5, SETTINGS.gap_tolerance, SETTINGS.line_search_tolerance)
    return _solved(solve(problem(spark, sf), half).improve())


@query
def frank_wolfe_gaps(spark, sf):
    """The gap that each of four steps starts from."""
    p, gaps = problem(spark, sf), []
    found = solve(p, FrankWolfeSettings(1, 1e-4, 1e-6))
    for k in range(1, 5):
        gaps.append((k, round(found.gap, 4) + 0.0))
        found = found.improve() if k < 4 else found
    return spark.createDataFrame(gaps, "iteration long, gap double")


def _path_flows(spark, sf):
    found = solve(problem(spark, sf), FrankWolfeSettings(3, 1e-4, 1e-6), keep_paths=True)
    return pathflow.estimate(found)


@query
def path_flows(spark, sf):
    _, values = _path_flows(spark, sf)
    links = F.array_join(F.transform("links", lambda x: x.cast("string")), "-")
    return values.select("col", "trip_id", links.alias("links"), F.round("flow", 6).alias("flow"))


@query
def path_flow_residual(spark, sf):
    """By how much path flows miss the volumes and link flows."""
    program, values = _path_flows(spark, sf)
    return program.residual(values).select(F.round("residual", 6).alias("residual"))


@query
def fleet_size(spark, sf):
    """The least vehicle time a trip on the paths of three steps, at the costs after them."""
    found = solve(problem(spark, sf), FrankWolfeSettings(3, 1e-4, 1e-6), keep_paths=True)
    numbered = cut(pathflow.number_paths(found.paths.select("trip_id", "links").distinct()))
    demand = found.problem.demand
    best = pathflow.fleet_program(numbered, demand, found.flow).minimize(1e-9)
    return demand.agg(F.sum("volume").alias("volume")).select(F.lit(best.status).alias("status"), F.round(F.lit(best.objective) / F.col("volume"), 4).alias("time_a_trip"))


@query
def fleet_relocation(spark, sf):
    """The least moves between nations next to each other after every order has taken a vehicle along."""
    orders = testnet.demand(spark, sf)
    ends = orders.select(F.explode(F.array(F.struct(F.col("source").alias("node"), (-F.col("volume")).alias("x")), F.struct(F.col("target").alias("node"), F.col("volume").alias("x")))).alias("e"))
    nations = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("node"))
    surplus = cut(nations.join(ends.groupBy("e.node").agg(F.sum("e.x").alias("surplus")), "node", "left").select("node", F.coalesce("surplus", F.lit(0.0)).alias("surplus")))
    there = nations.where(F.col("node") > 0).select((2 * F.col("node")).alias("link_id"), (F.col("node") - 1).alias("u"), F.col("node").alias("v"))
    roads = there.unionByName(there.select((F.col("link_id") + 1).alias("link_id"), F.col("v").alias("u"), F.col("u").alias("v"))).withColumn("cost", F.lit(1.0))
    best = pathflow.relocation_program(surplus, cut(roads)).minimize(1e-9)
    return spark.range(1).select(F.lit(best.status).alias("status"), F.lit(round(best.objective)).cast("long").alias("moves"))


@query
def linear_equilibrium(spark, sf):
    """Ten steps at costs that grow linearly with the flow."""
    p = problem(spark, sf)
    links = p.links.withColumns({"coefficient": F.col("free_flow_time") / 1000, "constant": F.col("capacity") / 1000})
    return _solved(solve(Problem(cut(links), p.demand, Linear(), "nations", 25), SETTINGS))
