"""Scalar functions of road links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bounds of a capacity; the upper one marks a centroid connector.
MIN_CAPACITY, INF_CAPACITY = 100, 9999


def clip(x: Column, low, high) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def capacity(x: Column) -> Column:
    return clip(x, MIN_CAPACITY, INF_CAPACITY)


def is_link(lanes: Column) -> Column:
    """Whether the link exists in this direction."""
    return lanes > 0


def is_virtual(capacity_: Column) -> Column:
    """Whether the (clipped) capacity marks a centroid connector."""
    return capacity_ >= INF_CAPACITY


def free_flow_time(length: Column, speed: Column, corrected: bool = False) -> Column:
    """0 for links without length, else speed / length; ``corrected`` gives length / speed instead.

    Published results rest on the first form, so it is the default.
    """
    ratio = F.try_divide(length, speed) if corrected else F.try_divide(speed, length)
    return F.when(length <= 0, F.lit(0.0)).otherwise(ratio)


def to_zone(i: Column) -> Column:
    return i + 1


def nonzero(x: Column) -> Column:
    """NaN counts as nonzero."""
    return (x != 0) | F.isnan(x)
