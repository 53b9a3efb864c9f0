"""Linear programs by the primal-dual hybrid gradient method.

A step needs two products with the matrix, which stays distributed by rows: each task holds
all entries of its rows, moves their prices and sends what these make of the columns, which
is summed by column.  Only the vectors of variables and prices (a checked size) are on the
driver.  Where the matrix is a single block its task takes many steps in one job.  Steps
are scaled by row and column, averaged, and restarted from the average as errors fall.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut, drop
from .graph import dense_ids

#: Variables and rows whose vectors the driver holds (8 bytes each, a few of them).
MAX_VECTOR = 4_000_000
#: Matrix entries of a block, which one task holds.
BLOCK = 1_000_000
#: Steps between two looks at the errors.
STEPS = 64
INF = float("inf")


@dataclass(frozen=True)
class Solution:
    """``status`` is optimal, infeasible, unbounded or rounds; values (col, flow) and prices (cid, price).

    Of an infeasible program the prices are a certificate: rows added up with these weights
    ask for more than any values within their bounds make.  Of an unbounded one the values
    are a direction in which the objective falls for ever.
    """

    status: str
    objective: float
    values: DataFrame
    prices: DataFrame
    error: float
    steps: int


@dataclass
class _Vectors:
    """A program's vectors: cost and bounds by column, right side and bounds of the price by row."""

    cost: np.ndarray
    lower: np.ndarray
    upper: np.ndarray
    rhs: np.ndarray
    least: np.ndarray
    most: np.ndarray
    tau: np.ndarray
    sigma: np.ndarray


def _product(entries: pd.DataFrame, x: np.ndarray, to: str, n: int) -> np.ndarray:
    by = "j" if to == "i" else "i"
    return np.bincount(entries[to].to_numpy(), entries["value"].to_numpy() * x[entries[by].to_numpy()], n)


def _primal(v: _Vectors, x, aty, weight):
    return np.clip(x - v.tau / weight * (v.cost - aty), v.lower, v.upper)


def _dual(v: _Vectors, y, ax, weight):
    return np.clip(y + v.sigma * weight * (v.rhs - ax), v.least, v.most)


class _Matrix:
    """The blocks of rows and the jobs on them."""

    def __init__(self, entries: DataFrame, m: int, n: int, block: int):
        self.m, self.n = m, n
        size = entries.count()
        self.single = 0 < size <= block
        held = entries.coalesce(1) if self.single else entries.repartition(max(1, -(-size // block)), "i")
        self.entries = held.persist(StorageLevel.MEMORY_AND_DISK)
        self.context = entries.sparkSession.sparkContext

    def _run(self, work, schema: str, shared) -> DataFrame:
        sent = self.context.broadcast(shared)

        def run(batches):
            parts = list(batches)  # a block
            if parts:
                yield work(pd.concat(parts), sent.value)

        out = self.entries.mapInPandas(run, schema).toPandas()
        sent.destroy()
        return out

    def sums(self, of: str) -> np.ndarray:
        rows = self.entries.groupBy(of).agg(F.sum(F.abs("value")).alias("s")).toPandas()
        out = np.zeros(self.m if of == "i" else self.n)
        out[rows[of]] = rows["s"]
        return np.where(out > 0, out, 1.0)

    def products(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(A x, y A); each task sends a sum for each of its rows and columns."""
        m, n = self.m, self.n

        def work(entries, shared):
            ax, aty = _product(entries, shared[0], "i", m), _product(entries, shared[1], "j", n)
            i, j = np.unique(entries["i"]), np.unique(entries["j"])
            return pd.DataFrame({"row": np.r_[np.ones(len(i), bool), np.zeros(len(j), bool)], "k": np.r_[i, j], "s": np.r_[ax[i], aty[j]]})

        rows = self._run(work, "row boolean, k long, s double", (x, y))
        side = rows["row"].to_numpy(bool)
        made = [np.bincount(rows["k"].to_numpy()[s], rows["s"].to_numpy()[s], size) for s, size in ((side, m), (~side, n))]
        return made[0], made[1]

    def steps(self, v: _Vectors, x, y, aty, weight: float, k: int):
        """(x, y, y A, sum of x, sum of y) after ``k`` steps."""
        m, n = self.m, self.n
        if self.single:

            def many(entries, shared):
                v, x, y, aty, weight = shared
                sx, sy = np.zeros(n), np.zeros(m)
                for _ in range(k):
                    new = _primal(v, x, aty, weight)
                    y = _dual(v, y, _product(entries, 2 * new - x, "i", m), weight)
                    x, aty = new, _product(entries, y, "j", n)
                    sx, sy = sx + x, sy + y
                return pd.DataFrame({"x": [x], "y": [y], "aty": [aty], "sx": [sx], "sy": [sy]})

            kind = ", ".join(f"{c} array<double>" for c in ("x", "y", "aty", "sx", "sy"))
            row = self._run(many, kind, (v, x, y, aty, weight)).iloc[0]
            return tuple(np.array(row[c], float) for c in ("x", "y", "aty", "sx", "sy"))

        def one(entries, shared):
            v, over, y, weight = shared
            own = np.unique(entries["i"])
            moved = np.zeros(m)
            moved[own] = _dual(v, y, _product(entries, over, "i", m), weight)[own]
            j = np.unique(entries["j"])
            return pd.DataFrame({"row": np.r_[np.ones(len(own), bool), np.zeros(len(j), bool)], "k": np.r_[own, j], "s": np.r_[moved[own], _product(entries, moved, "j", n)[j]]})

        sx, sy = np.zeros(n), np.zeros(m)
        for _ in range(k):
            new = _primal(v, x, aty, weight)
            rows = self._run(one, "row boolean, k long, s double", (v, 2 * new - x, y, weight))
            side = rows["row"].to_numpy(bool)
            y = _dual(v, y, np.zeros(m), weight)  # that of rows without entries
            y[rows["k"].to_numpy()[side]] = rows["s"].to_numpy()[side]
            aty = np.bincount(rows["k"].to_numpy()[~side], rows["s"].to_numpy()[~side], n)
            x = new
            sx, sy = sx + x, sy + y
        return x, y, aty, sx, sy


def _times(bound: np.ndarray, x: np.ndarray) -> float:
    """The sum of bound * x where x isn't 0; an infinite bound has been taken out of x before."""
    return float(np.sum(np.where(x != 0, np.where(np.isfinite(bound), bound, 0.0) * x, 0.0)))


def _errors(v: _Vectors, x, y, ax, aty) -> tuple[float, float, float]:
    """(objective, largest relative error, bound on the objective by the prices)."""
    short = v.rhs - ax
    short = np.where(np.isneginf(v.least) & np.isposinf(v.most), np.abs(short), np.where(v.least == 0, np.maximum(short, 0), np.maximum(-short, 0)))
    reduced = v.cost - aty
    up, down = np.maximum(reduced, 0), np.minimum(reduced, 0)
    wrong = np.where(np.isfinite(v.lower), 0, up) - np.where(np.isfinite(v.upper), 0, down)
    value = float(v.cost @ x)
    bound = float(v.rhs @ y) + _times(v.lower, np.where(np.isfinite(v.lower), up, 0)) + _times(v.upper, np.where(np.isfinite(v.upper), down, 0))
    primal = float(short.max(initial=0)) / (1 + float(np.abs(v.rhs).max(initial=0)))
    dual = float(wrong.max(initial=0)) / (1 + float(np.abs(v.cost).max(initial=0)))
    return value, max(primal, dual, abs(value - bound) / (1 + abs(value) + abs(bound))), bound


#: How much larger than the values seen so far those may be that a certificate must rule out.
BEYOND = 100.0


def _infeasible(v: _Vectors, x, y, aty) -> bool:
    """Whether prices prove that no values meet the rows: at no cost their bound is above 0.

    What a price vector that is off by ``wrong`` in some column proves holds for values whose sum
    times ``wrong`` is less than the bound: those up to BEYOND times the present ones.
    """
    size = float(np.abs(y).max(initial=0))
    if size == 0:
        return False
    y, pull = y / size, -aty / size
    up, down = np.maximum(pull, 0), np.minimum(pull, 0)
    wrong = float((np.where(np.isfinite(v.lower), 0, up) - np.where(np.isfinite(v.upper), 0, down)).max(initial=0))
    bound = float(v.rhs @ y) + _times(v.lower, np.where(np.isfinite(v.lower), up, 0)) + _times(v.upper, np.where(np.isfinite(v.upper), down, 0))
    # Rounding of the bound itself must not pass for a proof either.
    return bound > 1e-9 * (1 + float(np.abs(v.rhs * y).sum())) and wrong * BEYOND * (1 + float(np.abs(x).sum())) <= bound


def _unbounded(v: _Vectors, x, ax, y) -> bool:
    """Whether ``x`` is a direction that stays within rows and bounds and lowers the objective, at prices up to BEYOND times ``y``."""
    size = float(np.abs(x).max(initial=0))
    if size == 0:
        return False
    x, ax = x / size, ax / size
    fall = -float(v.cost @ x)
    off = np.where(np.isneginf(v.least) & np.isposinf(v.most), np.abs(ax), np.where(v.least == 0, np.maximum(-ax, 0), np.maximum(ax, 0)))
    out = np.maximum(np.where(np.isfinite(v.lower), -x, 0), np.where(np.isfinite(v.upper), x, 0))
    wrong = max(float(off.max(initial=0)), float(out.max(initial=0)))
    return fall > 1e-9 * (1 + float(np.abs(v.cost * x).sum())) and wrong * BEYOND * (1 + float(np.abs(y).sum())) <= fall


def minimize(constraints: DataFrame, coefficients: DataFrame, variables: DataFrame | None = None, tolerance: float = 1e-8, max_steps: int = 200_000, block: int = BLOCK) -> Solution:
    """The values of least cost that meet all rows.

    ``constraints`` is (cid, sense, rhs) with the senses =, < and > (the last two include
    equality), ``coefficients`` (row, col, value), of which repeated ones add up, and
    ``variables`` (col, cost, lower, upper); nulls and columns without a row cost nothing and go
    from 0 on without a bound.  Errors are relative to the largest right side and cost, that
    of the objective to itself.  Raises for more than MAX_VECTOR variables or rows, and
    for coefficients of unknown rows.
    """
    spark = constraints.sparkSession
    cols = coefficients.select("col") if variables is None else coefficients.select("col").unionByName(variables.select("col"))
    rows_ = cut(dense_ids(constraints.select("cid", "sense", F.col("rhs").cast("double").alias("rhs")), "i", "cid"))
    cols_ = cut(dense_ids(cols.distinct(), "j", "col"))
    m, n = rows_.count(), cols_.count()
    if max(m, n) > MAX_VECTOR:
        raise ValueError(f"at most {MAX_VECTOR} variables and rows")
    summed = coefficients.groupBy("row", "col").agg(F.sum(F.col("value").cast("double")).alias("value")).where("value <> 0")
    entries = cut(summed.join(rows_.select(F.col("cid").alias("row"), "i"), "row", "left").join(cols_.select("col", "j"), "col").select("i", "j", "value"))
    if not entries.where("i is null").isEmpty():
        raise ValueError("a coefficient is of a row that isn't among the constraints")
    right = rows_.orderBy("i").toPandas()
    unknown = set(right["sense"]) - {"=", "<", ">"}
    if unknown:
        raise ValueError(f"senses must be =, < or >, not {sorted(map(str, unknown))}")
    if variables is None:
        bounds = pd.DataFrame({"cost": np.zeros(n), "lower": np.zeros(n), "upper": np.full(n, INF)})
    else:
        own = variables.select("col", *(F.col(c).cast("double").alias(c) for c in ("cost", "lower", "upper")))
        filled = cols_.join(own, "col", "left").select("j", F.coalesce("cost", F.lit(0.0)).alias("cost"), F.coalesce("lower", F.lit(0.0)).alias("lower"), F.coalesce("upper", F.lit(INF)).alias("upper"))
        bounds = filled.orderBy("j").toPandas()
    sense = right["sense"].to_numpy()
    matrix = _Matrix(entries, m, n, block)
    v = _Vectors(
        bounds["cost"].to_numpy(float), bounds["lower"].to_numpy(float), bounds["upper"].to_numpy(float), right["rhs"].to_numpy(float),
        np.where(sense == ">", 0.0, -INF), np.where(sense == "<", 0.0, INF), 0.95 / matrix.sums("j"), 0.95 / matrix.sums("i"),
    )
    try:
        status, x, y, error, steps = _iterate(matrix, v, tolerance, max_steps)
    finally:
        matrix.entries.unpersist()
        drop(entries)
    frame = lambda names, ids, kind, values, name: spark.createDataFrame(pd.DataFrame({names: ids, name: values}), f"{names} {kind}, {name} double")
    values = frame("col", cols_.orderBy("j").toPandas()["col"], cols_.schema["col"].dataType.simpleString(), x, "flow")
    prices = frame("cid", right["cid"], rows_.schema["cid"].dataType.simpleString(), y, "price")
    return Solution(status, float(v.cost @ x), values, prices, error, steps)


def _iterate(matrix: _Matrix, v: _Vectors, tolerance: float, max_steps: int):
    if (v.lower > v.upper).any():
        return "infeasible", np.clip(np.zeros(matrix.n), v.lower, v.upper), np.zeros(matrix.m), INF, 0
    x = np.clip(np.zeros(matrix.n), v.lower, v.upper)
    y = np.zeros(matrix.m)
    size = lambda a: float(np.linalg.norm(a))
    weight = size(v.cost) / size(v.rhs) if size(v.cost) and size(v.rhs) else 1.0
    aty = np.zeros(matrix.n)
    begun, since, sx, sy = (x, y), 0, np.zeros_like(x), np.zeros_like(y)
    last_error, steps = INF, 0
    while True:
        k = min(STEPS, max(1, max_steps - steps))
        x0, y0 = x, y
        x, y, aty, ax_, ay_ = matrix.steps(v, x, y, aty, weight, k)
        steps, since, sx, sy = steps + k, since + k, sx + ax_, sy + ay_
        mean = sx / since, sy / since
        found = []
        for p, d in ((x, y), mean):
            ax, da = matrix.products(p, d)
            found.append((_errors(v, p, d, ax, da)[1], p, d, da))
        error, p, d, da = min(found, key=lambda f: f[0])
        if error <= tolerance:
            return "optimal", p, d, error, steps
        # What the vectors do from look to look converges to a certificate where there is no optimum.
        ax, da_ = matrix.products(x - x0, y - y0)
        if _infeasible(v, p, y - y0, da_):
            return "infeasible", p, y - y0, error, steps
        if _unbounded(v, x - x0, ax, d):
            return "unbounded", x - x0, d, error, steps
        if steps >= max_steps:
            return "rounds", p, d, error, steps
        if error < 0.3 * last_error or since >= 0.4 * steps:
            dx, dy = size(p - begun[0]), size(d - begun[1])
            if dx > 1e-12 and dy > 1e-12:
                weight = float(np.exp(0.5 * np.log(dy / dx) + 0.5 * np.log(weight)))
            x, y, aty = p, d, da
            begun, since, sx, sy, last_error = (x, y), 0, np.zeros_like(x), np.zeros_like(y), error
