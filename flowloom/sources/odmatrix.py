"""Origin-destination matrices in comma-separated files without a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cost import Bpr, check_capacity
from ..operators.demand import compile_demand, travel_demand
from ..operators.equilibrium import Problem
from . import shapefile
from .tntp import lines, numbered


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(file, i, j, value) of all cells of the files of a path; what isn't a number is NaN."""
    rows = numbered(lines(spark, path)).where(F.length(F.trim("line")) > 0)
    cells = rows.select("file", F.col("row").alias("i"), F.posexplode(F.split("line", ",", -1)).alias("j", "text"))
    return cells.select("file", "i", F.col("j").cast("long").alias("j"), F.coalesce(F.trim("text").try_cast("double"), F.lit(float("nan"))).alias("value"))


def read_directory(spark: SparkSession, directory: str) -> DataFrame:
    """The cells of all ``*.csv`` files of a folder; a folder without one raises."""
    return read_matrix(spark, f"{directory.rstrip('/')}/*.csv")


def problem_from_shapefiles(spark: SparkSession, directory: str, node_file: str = shapefile.DEFAULT_NODES, link_file: str = shapefile.DEFAULT_LINKS, corrected_times: bool = False) -> Problem:
    """Network, demand (folder ODmatrix) and BPR costs (0.15, 4) of a folder of shapefiles."""
    nodes, links, zones = shapefile.read_network(spark, directory, node_file, link_file)
    links = shapefile.extended(links, corrected_times)
    check_capacity(links)
    demand = compile_demand(travel_demand(read_directory(spark, f"{directory}/ODmatrix"), zones))
    return Problem(links.select("link_id", "u", "v", F.col("capacity").cast("double").alias("capacity"), "free_flow_time"), demand, Bpr(0.15, 4.0), name=directory.rstrip("/").rsplit("/", 1)[-1])
