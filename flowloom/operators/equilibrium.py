"""User equilibrium and system optimum by the Frank-Wolfe method."""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cost import LinkCost, marginal
from ..scratch import cut, drop
from .corridor import prepared
from .loading import link_flow, tree_flow
from .paths import MAX_BROADCAST_LINKS, Adjacency, adjacency, by_source, load_trips, search_trips, shortest_paths

#: Halvings after which a line search stops though it still stands above the optimum.
MAX_HALVINGS = 200


@dataclass(frozen=True)
class Problem:
    """Links with the cost function's columns, demand and the cost function."""

    links: DataFrame
    demand: DataFrame
    cost: LinkCost
    name: str = ""
    number_of_nodes: int | None = None


@dataclass(frozen=True)
class FrankWolfeSettings:
    max_iterations: int
    gap_tolerance: float
    line_search_tolerance: float


@dataclass
class Result:
    """Flows and costs by link, the gap of the step before and the paths that were used."""

    problem: Problem
    settings: FrankWolfeSettings
    flow: DataFrame
    gap: float
    iterations: int
    duration: float
    paths: DataFrame | None = None
    weights: list[float] = field(default_factory=list)

    def improve(self, keep_paths: bool = False) -> Result:
        """Up to ``max_iterations`` further steps from here; iterations, time and paths add up."""
        more = _run(self.problem, self.settings, self.flow.select("link_id", "flow"), keep_paths or self.paths is not None, len(self.weights))
        paths = self.paths if more.paths is None else more.paths if self.paths is None else self.paths.unionByName(more.paths)
        return replace(more, iterations=self.iterations + more.iterations, duration=self.duration + more.duration, paths=paths, weights=self.weights + more.weights)


def tstt(links: DataFrame) -> DataFrame:
    """(tstt): the total travel time of links with flow and cost."""
    return links.agg(F.sum(F.col("flow") * F.col("cost")).alias("tstt"))


def sptt(demand: DataFrame, best: DataFrame) -> DataFrame:
    """(sptt): the travel time if every trip took its best path (trip_id, cost)."""
    return demand.join(best, "trip_id").agg(F.sum(F.col("volume") * F.col("cost")).alias("sptt"))


def average_excess_cost(links: DataFrame, demand: DataFrame, best: DataFrame) -> DataFrame:
    """(gap): (tstt - sptt) / total volume, of links with flow and cost."""
    volume = demand.agg(F.sum("volume").alias("volume"))
    return tstt(links).join(sptt(demand, best)).join(volume).select(((F.col("tstt") - F.col("sptt")) / F.col("volume")).alias("gap"))


def bisect(sigma, tolerance: float) -> float:
    """The last step tried by halving [0, 1] for the zero of ``sigma``, a rising function.

    Goes on while the interval is wider than the tolerance or the last value is above 0.
    """
    low, high, value, at = 0.0, 1.0, 0.0, 0.0
    for _ in range(MAX_HALVINGS):
        if not (high - low > tolerance or value > 0):
            break
        at = 0.5 * (low + high)
        value = sigma(at)
        low, high = (at, high) if value < 0 else (low, at)
    return at


def line_search(links: DataFrame, cost: LinkCost, tolerance: float, grid_bits: int = 5) -> float:
    """The step along ``direction`` of links with ``flow``.

    If the slope is a polynomial of the step, one aggregation gives its coefficients and
    the bisection is arithmetic.  Else each job evaluates 2 ** grid_bits - 1 steps at once,
    as many halvings as there are bits.
    """
    terms = cost.direction_terms(F.col("flow"), F.col("direction"))
    if terms is not None:
        k = [x or 0.0 for x in links.agg(*(F.sum(t).alias(f"c{i}") for i, t in enumerate(terms))).first()]
        return bisect(lambda a: sum(c * a**i for i, c in enumerate(k)), tolerance)
    known: dict[float, float] = {}

    def sigma(at: float) -> float:
        if at not in known:
            step = _grid_step(at, grid_bits)
            steps = [at + step * i for i in range(-(2 ** (grid_bits - 1)) + 1, 2 ** (grid_bits - 1))]
            known.update(_slopes(links, cost, [s for s in steps if 0 < s < 1]))
        return known[at]

    return bisect(sigma, tolerance)


def _grid_step(at: float, bits: int) -> float:
    """The spacing of the next halvings around ``at``, whose own halving is its lowest binary digit."""
    digit = 1.0
    while at % digit:
        digit /= 2
    return digit / 2 ** (bits - 1)


def _slopes(links: DataFrame, cost: LinkCost, steps: list[float]) -> dict[float, float]:
    d = F.col("direction")
    row = links.agg(*(F.sum(cost.cost(F.col("flow") + F.lit(s) * d) * d).alias(f"s{i}") for i, s in enumerate(steps))).first()
    return dict(zip(steps, row))


def slope_grid(links: DataFrame, cost: LinkCost, steps: list[float]) -> DataFrame:
    """(step, sigma): sum(cost(flow + step * direction) * direction) for each step."""
    at = links.withColumn("step", F.explode(F.array(*map(F.lit, steps))))
    return at.groupBy("step").agg(F.sum(cost.cost(F.col("flow") + F.col("step") * F.col("direction")) * F.col("direction")).alias("sigma"))


def solve(problem: Problem, settings: FrankWolfeSettings, keep_paths: bool = False, max_links: int = MAX_BROADCAST_LINKS) -> Result:
    """Link flows from the loading at no flow, improved until the gap or the iterations are reached.

    Up to ``max_links`` links the link vectors are held as arrays on the driver and one
    job a step searches all sources; larger networks stay in DataFrames throughout.
    ``keep_paths`` keeps (iteration, trip_id, links, volume) of every loading.
    """
    return _run(problem, settings, None, keep_paths, 0, max_links)


def system_optimum(problem: Problem, settings: FrankWolfeSettings, **options) -> Result:
    """The flows of least total cost: the equilibrium at marginal costs."""
    return solve(replace(problem, cost=marginal(problem.cost)), settings, **options)


def _run(problem: Problem, settings: FrankWolfeSettings, flow: DataFrame | None, keep_paths: bool, done: int, max_links: int = MAX_BROADCAST_LINKS) -> Result:
    names = ["link_id", "u", "v", *dict.fromkeys(problem.cost.columns())]
    links = problem.links.select(*names)
    if flow is not None:
        links = links.join(flow, "link_id")
    held = adjacency(links, max_links)
    run = _in_frames if held is None else _in_arrays
    return run(problem, settings, links if held is None else held, flow is not None, keep_paths, done)


def _path_sums(found: DataFrame) -> DataFrame:
    """The sums of :func:`.paths.load_trips` of trips whose paths are kept."""
    used = found.select(F.explode("links").alias("link_id"), F.col("volume").alias("flow")).groupBy("link_id").agg(F.sum("flow").alias("flow"))
    totals = found.agg(F.coalesce(F.sum(F.col("volume") * F.col("cost")), F.lit(0.0)).alias("best"), F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"))
    zero = F.lit(0.0)
    return used.select("link_id", "flow", zero.alias("best"), zero.alias("volume")).unionByName(totals.select(F.lit(None).cast("long").alias("link_id"), zero.alias("flow"), "best", "volume"))


def _in_arrays(problem: Problem, settings: FrankWolfeSettings, held: tuple[Adjacency, pd.DataFrame], warm: bool, keep_paths: bool, done: int) -> Result:
    began = time.perf_counter()
    graph, rows = held
    columns = {c: rows[c].to_numpy(float) for c in problem.cost.columns()}
    ids = graph.link_id.tolist()
    context = problem.links.sparkSession.sparkContext
    network = context.broadcast(graph)  # once; a step sends its costs alone
    demand = cut(by_source(problem.demand))
    kept: list[DataFrame] = []
    weights: list[float] = []

    places = np.argsort(graph.link_id, kind="stable")

    def load(cost: np.ndarray) -> tuple[np.ndarray, float, float]:
        prices, core = context.broadcast(cost), prepared(demand, graph, cost)
        if keep_paths:
            found = cut(search_trips(demand, network, prices, core))
            kept.append(found.where("links is not null").select(F.lit(done + len(weights)).cast("long").alias("iteration"), "trip_id", "links", "volume"))
            sums = _path_sums(found)
        else:
            sums = load_trips(demand, network, prices, core)
        rows = sums.toArrow()  # a row for each link, whose number is checked
        prices.destroy()
        if core is not None:
            core.destroy()
        used = rows["link_id"].is_valid().to_numpy()
        out = np.zeros(len(ids))
        out[places[np.searchsorted(graph.link_id, rows["link_id"].drop_null().to_numpy(), sorter=places)]] = rows["flow"].to_numpy()[used]
        return out, float(rows["best"].to_numpy().sum()), float(rows["volume"].to_numpy().sum())

    if warm:
        flow = rows["flow"].to_numpy(float)
    else:
        flow, _, _ = load(problem.cost.values(np.zeros(len(ids)), columns))
        weights.append(1.0)
    cost = problem.cost.values(flow, columns)
    gap, k = settings.gap_tolerance + 1, 0
    while k < settings.max_iterations and gap > settings.gap_tolerance:
        target, best, volume = load(cost)
        gap = (float(flow @ cost) - best) / volume
        direction = target - flow
        step = bisect(lambda a: float(problem.cost.values(flow + a * direction, columns) @ direction), settings.line_search_tolerance)
        flow = flow + step * direction
        cost = problem.cost.values(flow, columns)
        weights.append(step)
        k += 1
    network.destroy()
    drop(demand)
    spark = problem.links.sparkSession
    state = spark.createDataFrame(pd.DataFrame({"link_id": ids, "flow": flow, "cost": cost}), "link_id long, flow double, cost double")
    paths = None
    for part in kept:
        paths = part if paths is None else paths.unionByName(part)
    return Result(problem, settings, state, gap, k, time.perf_counter() - began, paths, weights)


def _in_frames(problem: Problem, settings: FrankWolfeSettings, links: DataFrame, warm: bool, keep_paths: bool, done: int) -> Result:
    began = time.perf_counter()
    demand = problem.demand
    links = cut(links)
    kept: list[DataFrame] = []
    weights: list[float] = []

    def load(costed: DataFrame) -> tuple[DataFrame, DataFrame]:
        if not keep_paths:
            flow, sums = tree_flow(costed, demand, max_links=0)
            return flow, sums.first()
        found = cut(shortest_paths(costed, demand, max_links=0))
        kept.append(found.where("links is not null").select(F.lit(done + len(weights)).cast("long").alias("iteration"), "trip_id", "links", "volume"))
        return link_flow(found, links), found.agg(F.sum(F.col("volume") * F.col("cost")).alias("best"), F.sum("volume").alias("volume")).first()

    if not warm:
        flow, _ = load(links.withColumn("cost", problem.cost.cost(F.lit(0.0))))
        links = cut(links.join(flow, "link_id"))
        weights.append(1.0)
    gap, k = settings.gap_tolerance + 1, 0
    while k < settings.max_iterations and gap > settings.gap_tolerance:
        costed = links.withColumn("cost", problem.cost.cost(F.col("flow")))
        target, sums = load(costed)
        gap = (costed.agg(F.sum(F.col("flow") * F.col("cost"))).first()[0] - (sums["best"] or 0.0)) / sums["volume"]
        moving = cut(links.join(target.withColumnRenamed("flow", "_target"), "link_id").withColumn("direction", F.col("_target") - F.col("flow")).drop("_target"))
        step = line_search(moving, problem.cost, settings.line_search_tolerance)
        links = cut(moving.withColumn("flow", F.col("flow") + F.lit(step) * F.col("direction")).drop("direction"))
        weights.append(step)
        k += 1
    state = links.select("link_id", "flow", problem.cost.cost(F.col("flow")).alias("cost"))
    paths = None
    for part in kept:
        paths = part if paths is None else paths.unionByName(part)
    return Result(problem, settings, state, gap, k, time.perf_counter() - began, paths, weights)
