"""A road network and demand derived from the driver's order tables.

Nations are nodes.  Goods flow from the supplier's nation to the customer's: the three
largest flows of each nation are its links, all flows are its trips.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import dense_ids

#: Lines of the tables that a task of a join holds, about.
TASK_LINES = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` over as many tasks as ``rows`` lines ask for, so that none holds more as the tables grow.

    Few rows are left to Spark, whose number of partitions doesn't grow with them.
    """
    tasks = -(-rows // TASK_LINES)
    return df if tasks <= df.sparkSession.sparkContext.defaultParallelism else df.repartition(tasks, *keys)


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, v, capacity, free_flow_time, orders).

    Lines are summed by order before pairs of nations are, so that distinct orders are
    counted without a second shuffle of the lines.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    lines = read("lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice")
    sellers = read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("u"))
    buyers = read("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    n = read("lineitem").count()  # from the footers
    lines, sellers = dealt(lines, n, "l_suppkey"), dealt(sellers, n, "l_suppkey")
    buyers = dealt(buyers, n, "c_custkey").join(dealt(read("customer"), n, "c_custkey").select("c_custkey", F.col("c_nationkey").cast("long").alias("v")), "c_custkey").select("l_orderkey", "v")
    sold = dealt(lines.join(sellers, "l_suppkey"), n, "l_orderkey").join(dealt(buyers, n, "l_orderkey"), "l_orderkey").where("u <> v")
    by_order = sold.groupBy("l_orderkey", "u", "v").agg(F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"), F.count("*").alias("n"))
    sums = by_order.groupBy("u", "v").agg(F.sum("quantity").alias("quantity"), F.sum("price").alias("price"), F.sum("n").alias("n"), F.count("*").alias("orders"))
    return sums.select("u", "v", F.col("quantity").cast("double").alias("capacity"), F.round(F.col("price").cast("double") / F.col("n") / 1000, 6).alias("free_flow_time"), "orders")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(link_id, u, v, capacity, free_flow_time)."""
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("capacity"), "v"))
    top = flows(spark, sf_dir).withColumn("_rank", rank).where("_rank <= 3")
    return dense_ids(top, "link_id", "u", "v").select("link_id", "u", "v", "capacity", "free_flow_time")


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trip_id, source, target, volume)."""
    pairs = flows(spark, sf_dir).select(F.col("u").alias("source"), F.col("v").alias("target"), F.col("orders").cast("double").alias("volume"))
    return dense_ids(pairs, "trip_id", "source", "target").select("trip_id", "source", "target", "volume")
