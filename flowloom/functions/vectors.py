"""Vector kernels over a column keyed by link or trip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(x: Column, y: Column) -> Column:
    """The aggregate sum of products."""
    return F.sum(x * y)


def add(x: Column, y: Column) -> Column:
    return x + y


def sub(x: Column, y: Column) -> Column:
    return x - y


def mul(x: Column, y: Column) -> Column:
    return x * y


def div(x: Column, y: Column) -> Column:
    """Null where the divisor is zero."""
    return F.try_divide(x, y)


def scale(x: Column, factor: float) -> Column:
    return x * F.lit(float(factor))


def add_constant(x: Column, constant: float) -> Column:
    return x + F.lit(float(constant))


def power(x: Column, exponent: float) -> Column:
    return F.pow(x, F.lit(float(exponent)))


def zeros(keys: DataFrame, value: str = "value") -> DataFrame:
    return keys.withColumn(value, F.lit(0.0))


def of(spark, values: list[float], key: str = "link_id", value: str = "value") -> DataFrame:
    """A vector of literal values, keyed by position."""
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(values)], f"{key} long, {value} double")


def length(vector: DataFrame) -> int:
    return vector.count()


def to_list(vector: DataFrame, key: str = "link_id", value: str = "value") -> list[float]:
    """In the order of keys; for small vectors."""
    return [r[value] for r in vector.orderBy(key).toLocalIterator()]


def error_metrics(found: DataFrame, expected: DataFrame, key: str = "link_id") -> DataFrame:
    """(relative_norm, cost_ratio_excess): how far flows and the flow-weighted cost are from expected ones.

    Both frames have the key, ``flow`` and ``cost``.
    """
    e = expected.select(key, F.col("flow").alias("e_flow"), F.col("cost").alias("e_cost"))
    joined = found.join(e, key)
    off = F.try_divide(F.col("flow") - F.col("e_flow"), F.col("e_flow"))
    return joined.agg(
        F.sqrt(F.sum(F.pow(off, F.lit(2.0)))).alias("relative_norm"),
        (F.try_divide(dot(F.col("flow"), F.col("cost")), dot(F.col("e_flow"), F.col("e_cost"))) - 1).alias("cost_ratio_excess"),
    )


def debug(frame: DataFrame, column: str, id_col: str = "link_id", n: int = 20) -> str:
    """The first ``n`` values of a vector as one line, in order of ids."""
    return " ".join(f"{r[0]:g}" for r in frame.orderBy(id_col).select(column).limit(n).collect())
