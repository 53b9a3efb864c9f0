"""Link cost functions of flow as column expressions.

A cost function names the link columns that it reads, so a network's attributes and its
flow stay columns of one row and no join is needed to evaluate it.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass
from typing import ClassVar

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LinkCost:
    """Costs nothing; the base of all cost functions and the point of extension."""

    name: ClassVar[str] = "free"

    def cost(self, flow: Column) -> Column:
        return F.lit(0.0)

    def columns(self) -> list[str]:
        """The link columns that the function reads."""
        return []

    def values(self, flow: np.ndarray, links: dict[str, np.ndarray]) -> np.ndarray:
        """The same for vectors of a network of bounded size."""
        return np.zeros_like(flow)

    def direction_terms(self, flow: Column, direction: Column) -> list[Column] | None:
        """Terms of sum(cost(flow + a * direction) * direction) by powers of a, if it is a polynomial."""
        return [F.lit(0.0)]

    def with_cost(self, links: DataFrame, flow: str = "flow") -> DataFrame:
        """``links`` with the column ``cost``; capacities of zero are refused by :func:`check_capacity`."""
        return links.withColumn("cost", self.cost(F.col(flow)))

    def spec(self) -> dict:
        return {"name": self.name, "kwargs": asdict(self)}


@dataclass(frozen=True)
class Bpr(LinkCost):
    """t0 * (1 + alpha * (flow / capacity) ** beta)."""

    alpha: float = 0.15
    beta: float = 4.0
    capacity: str = "capacity"
    free_flow_time: str = "free_flow_time"
    name: ClassVar[str] = "bpr"

    def _weight(self) -> float:
        return self.alpha

    def cost(self, flow: Column) -> Column:
        return F.col(self.free_flow_time) * (1 + F.lit(float(self._weight())) * F.pow(flow / F.col(self.capacity), F.lit(float(self.beta))))

    def columns(self) -> list[str]:
        return [self.capacity, self.free_flow_time]

    def values(self, flow, links):
        return links[self.free_flow_time] * (1 + self._weight() * (flow / links[self.capacity]) ** self.beta)

    def direction_terms(self, flow, direction):
        beta = int(self.beta)
        if beta != self.beta or beta < 0:
            return None
        t0, share = F.col(self.free_flow_time), F.lit(float(self._weight()))
        x, d = flow / F.col(self.capacity), direction / F.col(self.capacity)
        terms = [t0 * share * math.comb(beta, j) * F.pow(x, F.lit(float(beta - j))) * F.pow(d, F.lit(float(j))) * direction for j in range(beta + 1)]
        return [terms[0] + t0 * direction, *terms[1:]]


@dataclass(frozen=True)
class MarginalBpr(Bpr):
    """The marginal total cost of BPR: t0 * (1 + (1 + beta) * alpha * (flow / capacity) ** beta)."""

    name: ClassVar[str] = "marginal_bpr"

    def _weight(self) -> float:
        return self.alpha * (1 + self.beta)


@dataclass(frozen=True)
class Linear(LinkCost):
    """coefficient * flow + constant."""

    coefficient: str = "coefficient"
    constant: str = "constant"
    name: ClassVar[str] = "linear"
    _slope: ClassVar[float] = 1.0

    def cost(self, flow: Column) -> Column:
        return F.lit(self._slope) * F.col(self.coefficient) * flow + F.col(self.constant)

    def columns(self) -> list[str]:
        return [self.coefficient, self.constant]

    def values(self, flow, links):
        return self._slope * links[self.coefficient] * flow + links[self.constant]

    def direction_terms(self, flow, direction):
        return [self.cost(flow) * direction, F.lit(self._slope) * F.col(self.coefficient) * direction * direction]


@dataclass(frozen=True)
class MarginalLinear(Linear):
    """The marginal total cost of the linear function: 2 * coefficient * flow + constant."""

    name: ClassVar[str] = "marginal_linear"
    _slope: ClassVar[float] = 2.0


REGISTRY = {c.name: c for c in (Bpr, MarginalBpr, Linear, MarginalLinear)}


def from_spec(spec: dict) -> LinkCost:
    """The cost function of a saved name (in any case) and arguments; unknown names raise."""
    name = str(spec["name"]).lower()
    if name not in REGISTRY:
        raise ValueError(f"no cost function is called {name!r}")
    return REGISTRY[name](**spec["kwargs"])


def marginal(cost: LinkCost) -> LinkCost:
    """The marginal function, whose equilibrium is the system optimum of ``cost``."""
    turned = {Bpr: MarginalBpr, Linear: MarginalLinear}.get(type(cost))
    if turned is None:
        raise ValueError(f"{cost.name} has no marginal function here")
    return turned(**asdict(cost))


def check_capacity(links: DataFrame, capacity: str = "capacity") -> float:
    """The smallest capacity; raises unless it is positive, as costs divide by it."""
    least = links.agg(F.min(capacity)).first()[0]
    if least is not None and least <= 0:
        raise ValueError(f"the smallest capacity is {least}; it must be positive")
    return least


def per_link_bpr(flow: Column, alpha: str = "b", beta: str = "power", capacity: str = "capacity", free_flow_time: str = "free_flow_time") -> Column:
    """BPR with parameters of each link's own (opt-in; files are read with those of the first link)."""
    return F.col(free_flow_time) * (1 + F.col(alpha) * F.pow(flow / F.col(capacity), F.col(beta)))
