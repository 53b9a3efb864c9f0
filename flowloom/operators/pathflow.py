"""Path sets, their incidence matrices, the path-flow program and a path flow that solves it."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut, drop
from .equilibrium import Result
from .graph import dense_ids
from .lp import Solution, minimize


def distinct_paths(paths: DataFrame) -> DataFrame:
    """(trip_id, links): each link sequence once; of several trips that of the largest id, as in a store that overwrites."""
    return paths.groupBy("links").agg(F.max("trip_id").alias("trip_id")).select("trip_id", "links")


def number_paths(paths: DataFrame) -> DataFrame:
    """(path_id, trip_id, links) of distinct paths, in the order of trips and links."""
    return dense_ids(paths.withColumn("_order", F.to_json("links")), "path_id", "trip_id", "_order").select("path_id", "trip_id", "links")


def count_paths(paths: DataFrame) -> DataFrame:
    """(number_of_paths, number_of_links) in store."""
    return paths.agg(F.count("*").alias("number_of_paths"), F.coalesce(F.sum(F.size("links")), F.lit(0)).alias("number_of_links"))


def paths_by_source(paths: DataFrame, demand: DataFrame) -> DataFrame:
    """(source, number_of_paths, number_of_links)."""
    joined = paths.join(demand.select("trip_id", "source"), "trip_id")
    return joined.groupBy("source").agg(F.count("*").alias("number_of_paths"), F.sum(F.size("links")).alias("number_of_links"))


def trip_path(numbered: DataFrame) -> DataFrame:
    """Coordinates (row, col, value) of the incidence of trips (rows) and paths (columns)."""
    return numbered.select(F.col("trip_id").alias("row"), F.col("path_id").alias("col"), F.lit(1.0).alias("value"))


def link_path(numbered: DataFrame, first_row: int = 0) -> DataFrame:
    """Coordinates of the incidence of links (rows, from ``first_row`` on) and paths."""
    entries = numbered.select(F.explode("links").alias("link_id"), F.col("path_id").alias("col"))
    return entries.select((F.col("link_id") + F.lit(first_row)).cast("long").alias("row"), "col", F.lit(1.0).alias("value"))


def shape(coordinates: DataFrame) -> DataFrame:
    """(n_rows, n_cols, nnz): the least shape that holds the entries."""
    return coordinates.agg(F.coalesce(F.max("row") + 1, F.lit(0)).alias("n_rows"), F.coalesce(F.max("col") + 1, F.lit(0)).alias("n_cols"), F.count("*").alias("nnz"))


@dataclass(frozen=True)
class LinearProgram:
    """Rows (cid, sense, rhs), coefficients (row, col, value) and variables (col, cost, lower, upper).

    Without ``variables`` all are at least 0 and cost nothing, so that any feasible point is
    an optimum: where all rows are equalities :meth:`optimize` finds one, and
    :func:`path_flows` constructs one from the loadings of a result.  :meth:`minimize`
    solves any program.
    """

    constraints: DataFrame
    coefficients: DataFrame
    variables: DataFrame | None = None

    def add_constraints(self, constraints: DataFrame) -> LinearProgram:
        """The program with further rows (cid, sense, rhs), which may have no coefficient yet."""
        return replace(self, constraints=self.constraints.unionByName(constraints))

    def add_variables(self, variables: DataFrame, coefficients: DataFrame) -> LinearProgram:
        """The program with further variables (col, cost, lower, upper) and their coefficients (row, col, value)."""
        held = variables if self.variables is None else self.variables.unionByName(variables)
        return replace(self, variables=held, coefficients=self.coefficients.unionByName(coefficients))

    def minimize(self, tolerance: float = 1e-8, **options) -> Solution:
        """The values of least cost (:func:`.lp.minimize`)."""
        return minimize(self.constraints, self.coefficients, self.variables, tolerance, **options)

    def n_constraints(self) -> int:
        return self.constraints.count()

    def n_variables(self) -> int:
        cols = self.coefficients.select("col")
        return (cols if self.variables is None else cols.unionByName(self.variables.select("col"))).distinct().count()

    def rows(self) -> DataFrame:
        """(cid, line) of every constraint in the LP text format."""
        terms = self.coefficients.groupBy(F.col("row").alias("cid")).agg(F.array_join(F.sort_array(F.collect_list(F.when(F.col("value") == 1, F.format_string("x%d", "col")).otherwise(F.format_string("%s x%d", F.col("value").cast("string"), "col")))), " + ").alias("terms"))
        return self.constraints.join(terms, "cid", "left").select("cid", F.concat(F.format_string(" c%d: ", "cid"), F.coalesce("terms", F.lit("0 x0")), F.lit(" "), F.expr("CASE sense WHEN '<' THEN '<=' WHEN '>' THEN '>=' ELSE '=' END"), F.lit(" "), F.col("rhs").cast("string")).alias("line"))

    def write(self, path: str) -> None:
        """The program as text parts in ``path``; each variable's cost and bounds have lines of their own."""
        spark = self.constraints.sparkSession
        line = lambda place, text: spark.range(1).select(F.lit(place).alias("place"), F.lit(0).cast("long").alias("cid"), F.lit(text).alias("line"))
        out = line(0, "Minimize\n obj: 0 x0").unionByName(line(2, "Subject To")).unionByName(line(6, "End"))
        out = out.unionByName(self.rows().select(F.lit(3).alias("place"), "cid", "line"))
        if self.variables is not None:
            number = lambda c: F.when(F.col(c) == float("inf"), F.lit("inf")).when(F.col(c) == float("-inf"), F.lit("-inf")).otherwise(F.col(c).cast("string"))
            costs = self.variables.where("cost <> 0").select(F.lit(1).alias("place"), F.col("col").alias("cid"), F.format_string(" + %s x%d", F.col("cost").cast("string"), "col").alias("line"))
            own = self.variables.where("lower <> 0 or upper < double('infinity')")
            bounds = own.select(F.lit(5).alias("place"), F.col("col").alias("cid"), F.format_string(" %s <= x%d <= %s", F.coalesce(number("lower"), F.lit("0")), "col", F.coalesce(number("upper"), F.lit("inf"))).alias("line"))
            out = out.unionByName(costs).unionByName(line(4, "Bounds")).unionByName(bounds)
        out.orderBy("place", "cid").select("line").write.text(path)

    def optimize(self, tolerance: float = 1e-6, max_rounds: int = 200) -> DataFrame:
        """Values (col, flow) of at least 0 that meet all rows up to ``tolerance``, by multiplicative corrections.

        Every round scales each variable by the geometric mean of what its rows ask for over
        what they get, as two joins.  A row that asks for 0 empties its variables; a program
        that ``max_rounds`` rounds don't meet raises, be it infeasible or slow.
        """
        rows = self.coefficients.join(self.constraints.select(F.col("cid").alias("row"), "rhs"), "row")
        rows = cut(rows.where("value <> 0").select("row", "col", "value", "rhs"))
        values = cut(rows.groupBy("col").agg(F.min(F.col("rhs") / F.col("value")).alias("flow")))
        for _ in range(max_rounds):
            made = rows.join(values, "col").groupBy("row").agg(F.sum(F.col("value") * F.col("flow")).alias("made"), F.first("rhs").alias("rhs"))
            made = cut(made)
            worst = made.agg(F.max(F.abs(F.col("made") - F.col("rhs")))).first()[0]
            if worst is None or worst <= tolerance:
                drop(made, rows)
                return values
            share = F.when((F.col("rhs") > 0) & (F.col("made") > 0), F.log(F.col("rhs") / F.col("made"))).otherwise(F.lit(float("-inf")))
            scale = rows.join(made.select("row", share.alias("share")), "row").groupBy("col").agg(F.avg("share").alias("share"))
            new = cut(values.join(scale, "col").select("col", (F.col("flow") * F.exp("share")).alias("flow")))
            drop(made, values)
            values = new
        raise ValueError(f"no point within {tolerance} of all rows after {max_rounds} rounds")

    def get_values(self, values: DataFrame) -> list[float]:
        """The values of all variables in order of columns, on the driver."""
        return [r["flow"] for r in values.orderBy("col").select("flow").toLocalIterator()]

    def residual(self, values: DataFrame) -> DataFrame:
        """(residual): the largest absolute violation by values (col, flow)."""
        made = self.coefficients.join(values, "col").groupBy(F.col("row").alias("cid")).agg(F.sum(F.col("value") * F.col("flow")).alias("made"))
        return self.constraints.join(made, "cid", "left").agg(F.max(F.abs(F.coalesce("made", F.lit(0.0)) - F.col("rhs"))).alias("residual"))


def path_program(numbered: DataFrame, demand: DataFrame, flow: DataFrame) -> LinearProgram:
    """Trips' volumes and links' flows as equalities on path flows; link rows follow the trip rows."""
    n = demand.agg(F.coalesce(F.max("trip_id") + 1, F.lit(0))).first()[0]
    trips = demand.select(F.col("trip_id").alias("cid"), F.lit("=").alias("sense"), F.col("volume").alias("rhs"))
    links = flow.select((F.col("link_id") + n).alias("cid"), F.lit("=").alias("sense"), F.col("flow").alias("rhs"))
    return LinearProgram(trips.unionByName(links), trip_path(numbered).unionByName(link_path(numbered, n)))


def fleet_program(numbered: DataFrame, demand: DataFrame, costs: DataFrame) -> LinearProgram:
    """The least vehicle time that serves all trips on their paths.

    A path's variable costs the sum of ``costs`` (link_id, cost) over its links; by Little's law the
    objective is the number of vehicles under way.  ``demand`` are the trips that have a path.
    """
    rows = demand.select(F.col("trip_id").alias("cid"), F.lit("=").alias("sense"), F.col("volume").alias("rhs"))
    time = numbered.select(F.col("path_id").alias("col"), F.explode("links").alias("link_id")).join(costs.select("link_id", "cost"), "link_id").groupBy("col").agg(F.sum("cost").alias("cost"))
    free = F.lit(None).cast("double")
    return LinearProgram(rows, trip_path(numbered), time.select("col", "cost", free.alias("lower"), free.alias("upper")))


def relocation_program(surplus: DataFrame, roads: DataFrame) -> LinearProgram:
    """The cheapest moves of empty vehicles that even out ``surplus`` (node, surplus) over ``roads`` (link_id, u, v, cost).

    Every node sends what it has too much and gets what it lacks; moves may pass through nodes.
    """
    rows = surplus.select(F.col("node").alias("cid"), F.lit("=").alias("sense"), F.col("surplus").alias("rhs"))
    ends = roads.select(F.col("link_id").alias("col"), F.explode(F.array(F.struct(F.col("u").alias("row"), F.lit(1.0).alias("value")), F.struct(F.col("v").alias("row"), F.lit(-1.0).alias("value")))).alias("e"))
    free = F.lit(None).cast("double")
    return LinearProgram(rows, ends.select("e.row", "col", "e.value"), roads.select(F.col("link_id").alias("col"), F.col("cost").cast("double").alias("cost"), free.alias("lower"), free.alias("upper")))


def loading_weights(steps: list[float]) -> list[float]:
    """The share of each loading in the final flow: its step times what later steps leave of it."""
    out, left = [], 1.0
    for step in reversed(steps):
        out.append(step * left)
        left *= 1 - step
    return out[::-1]


def path_flows(result: Result) -> DataFrame:
    """(trip_id, links, flow): a path flow that meets all volumes and link flows of a result with paths.

    The link flow is a convex combination of loadings; giving each loading's paths its
    share of their trip's volume solves the path program, whose solutions aren't unique.
    """
    if result.paths is None:
        raise ValueError("the result has no paths; solve with keep_paths=True")
    spark = result.flow.sparkSession
    shares = spark.createDataFrame(list(enumerate(loading_weights(result.weights))), "iteration long, share double")
    joined = result.paths.join(F.broadcast(shares), "iteration")  # a number for each iteration
    return joined.groupBy("trip_id", "links").agg(F.sum(F.col("share") * F.col("volume")).alias("flow"))


def estimate(result: Result) -> tuple[LinearProgram, DataFrame]:
    """The path program of a result and path flows by column (col, trip_id, links, flow) that solve it."""
    flows = cut(path_flows(result))
    numbered = cut(number_paths(flows.select("trip_id", "links")))
    program = path_program(numbered, result.problem.demand, result.flow)
    values = numbered.join(flows, ["trip_id", "links"]).select(F.col("path_id").alias("col"), "trip_id", "links", "flow")
    return program, values
