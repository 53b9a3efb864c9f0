"""Saving and loading networks, demand, costs, problems, results and sparse matrices.

Small descriptions are JSON in the published layouts; vectors and paths are Parquet.
"""

from __future__ import annotations

import datetime
import io
import json
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cost import LinkCost, from_spec
from ..operators.equilibrium import FrankWolfeSettings, Problem, Result
from ..operators.graph import DiGraph


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One file by the file system of its path; an existing one raises."""
    target, fs = _fs(spark, path)
    out = fs.create(target, False)
    out.write(bytearray(data))
    out.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def read_bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


#: Links or trips up to which they stand in the JSON file itself; more are written as Parquet beside it.
MAX_JSON_ROWS = 1_000_000


def save_graph(graph: DiGraph, directory: str, max_rows: int = MAX_JSON_ROWS) -> None:
    """``network.json``: name, number_of_nodes and the edges in order of ids, or beyond ``max_rows`` null edges and ``network_edges``."""
    spark, links = graph.links_frame.sparkSession, graph.links_frame.select("link_id", "u", "v")
    if links.count() > max_rows:
        links.write.parquet(f"{directory}/network_edges")
        write_text(spark, f"{directory}/network.json", json.dumps({"name": graph.name, "number_of_nodes": graph.number_of_nodes, "edges": None}))
        return
    edges = F.transform(F.sort_array(F.collect_list(F.struct("link_id", "u", "v"))), lambda x: F.array(x.u, x.v))
    r = links.agg(F.to_json(F.struct(F.lit(graph.name).alias("name"), F.lit(graph.number_of_nodes).alias("number_of_nodes"), edges.alias("edges")))).first()
    write_text(spark, f"{directory}/network.json", r[0])


def load_graph(spark: SparkSession, directory: str) -> DiGraph:
    found = spark.read.schema("name string, number_of_nodes long, edges array<array<long>>").json(f"{directory}/network.json", multiLine=True)
    head = found.select("name", "number_of_nodes", F.col("edges").isNull().alias("beside")).first()
    if head["beside"]:
        return DiGraph(spark.read.parquet(f"{directory}/network_edges"), head["number_of_nodes"], head["name"])
    links = found.select(F.posexplode("edges").alias("link_id", "e")).select(F.col("link_id").cast("long").alias("link_id"), F.col("e")[0].alias("u"), F.col("e")[1].alias("v"))
    return DiGraph(links, head["number_of_nodes"], head["name"])


def save_demand(demand: DataFrame, directory: str, max_rows: int = MAX_JSON_ROWS) -> None:
    """``demand.json``: sources, volumes by trip, and targets and trips by source, in order of trips; beyond ``max_rows`` ``demand_trips``."""
    spark = demand.sparkSession
    if demand.count() > max_rows:
        demand.select("trip_id", "source", "target", "volume").write.parquet(f"{directory}/demand_trips")
        write_text(spark, f"{directory}/demand.json", json.dumps({"sources": None, "volumes": None, "targets": None, "trip_index": None}))
        return
    own = F.sort_array(F.collect_list(F.struct("trip_id", "target")))
    by = demand.groupBy("source").agg(F.min("trip_id").alias("first"), own.alias("own"))
    rows = F.sort_array(F.collect_list(F.struct("first", "source", "own")))
    r = by.agg(rows.alias("rows")).select(
        F.transform("rows", lambda x: x.source.cast("double")).alias("sources"),
        F.transform("rows", lambda x: F.transform(x.own, lambda y: y.target.cast("double"))).alias("targets"),
        F.transform("rows", lambda x: F.transform(x.own, lambda y: y.trip_id.cast("double"))).alias("trip_index"),
    )
    volumes = demand.agg(F.transform(F.sort_array(F.collect_list(F.struct("trip_id", "volume"))), lambda x: x.volume).alias("volumes"))
    text = r.join(volumes).select(F.to_json(F.struct("sources", "volumes", "targets", "trip_index"))).first()[0]
    write_text(spark, f"{directory}/demand.json", text)


def load_demand(spark: SparkSession, directory: str) -> DataFrame:
    found = spark.read.schema("sources array<double>, volumes array<double>, targets array<array<double>>, trip_index array<array<double>>").json(f"{directory}/demand.json", multiLine=True)
    if found.select(F.col("sources").isNull()).first()[0]:
        return spark.read.parquet(f"{directory}/demand_trips")
    by = found.select("volumes", F.explode(F.arrays_zip("sources", "targets", "trip_index")).alias("s"))
    rows = by.select("volumes", F.col("s.sources").cast("long").alias("source"), F.explode(F.arrays_zip("s.targets", "s.trip_index")).alias("t"))
    trip = F.col("t.trip_index").cast("int")
    return rows.select(trip.cast("long").alias("trip_id"), "source", F.col("t.targets").cast("long").alias("target"), F.get("volumes", trip).alias("volume"))


def save_cost(cost: LinkCost, links: DataFrame, directory: str) -> None:
    """``cost_function.json`` and the columns that it reads, by link."""
    write_text(links.sparkSession, f"{directory}/cost_function.json", json.dumps(cost.spec()))
    links.select("link_id", *dict.fromkeys(cost.columns())).write.parquet(f"{directory}/cost_columns")


def load_cost(spark: SparkSession, directory: str) -> tuple[LinkCost, DataFrame]:
    return from_spec(read_json(spark, f"{directory}/cost_function.json")), spark.read.parquet(f"{directory}/cost_columns")


def load_cost_arrays(spark: SparkSession, directory: str) -> tuple[str, DataFrame]:
    """(name, columns by link_id) of a ``cost_function.json`` that holds its columns as arrays; scalars repeat."""
    spec = read_json(spark, f"{directory}/cost_function.json")
    arrays = {k: v for k, v in spec["kwargs"].items() if isinstance(v, list)}
    scalars = {k: v for k, v in spec["kwargs"].items() if not isinstance(v, list)}
    frame = pd.DataFrame({"link_id": range(len(next(iter(arrays.values()), []))), **arrays})
    return spec["name"].lower(), spark.createDataFrame(frame).withColumns({k: F.lit(float(v)) for k, v in scalars.items()})


def save_settings(spark: SparkSession, settings: FrankWolfeSettings, path: str) -> None:
    write_text(spark, f"{path}.json", json.dumps(asdict(settings)))


def load_settings(spark: SparkSession, path: str) -> FrankWolfeSettings:
    return FrankWolfeSettings(**read_json(spark, f"{path}.json"))


def save_problem(problem: Problem, directory: str) -> None:
    nodes = problem.number_of_nodes
    if nodes is None:
        nodes = problem.links.agg(F.coalesce(F.max(F.greatest("u", "v")) + 1, F.lit(0))).first()[0]
    save_graph(DiGraph(problem.links, nodes, problem.name), directory)
    save_demand(problem.demand, directory)
    save_cost(problem.cost, problem.links, directory)


def load_problem(spark: SparkSession, directory: str) -> Problem:
    graph = load_graph(spark, directory)
    cost, columns = load_cost(spark, directory)
    return Problem(graph.links_frame.join(columns, "link_id"), load_demand(spark, directory), cost, graph.name, graph.number_of_nodes)


def save_result(result: Result, name: str, timestamp: str | None = None) -> str:
    """Save under ``name/results-<timestamp>``, by default the UTC time in seconds; an existing folder raises."""
    spark = result.flow.sparkSession
    stamp = timestamp or datetime.datetime.now(datetime.UTC).replace(tzinfo=None).isoformat(timespec="seconds")
    directory = f"{name}/results-{stamp.replace(':', '-')}"
    target, fs = _fs(spark, directory)
    if fs.exists(target):
        raise FileExistsError(directory)
    write_text(spark, f"{directory}/metadata.json", json.dumps({"gap": result.gap, "iterations": result.iterations, "duration": result.duration, "paths_db": "paths" if result.paths is not None else None, "weights": result.weights}))
    result.flow.write.parquet(f"{directory}/flow")
    if result.paths is not None:
        result.paths.write.parquet(f"{directory}/paths")
    save_settings(spark, result.settings, f"{directory}/settings")
    save_problem(result.problem, f"{directory}/problem")
    return directory


def load_result(spark: SparkSession, directory: str) -> Result:
    meta = read_json(spark, f"{directory}/metadata.json")
    paths = spark.read.parquet(f"{directory}/{meta['paths_db']}") if meta["paths_db"] else None
    return Result(load_problem(spark, f"{directory}/problem"), load_settings(spark, f"{directory}/settings"), spark.read.parquet(f"{directory}/flow"), meta["gap"], meta["iterations"], meta["duration"], paths, meta["weights"])


def save_sparse(coordinates: DataFrame, path: str) -> None:
    """Coordinates (row, col, value) as Parquet."""
    coordinates.select("row", "col", "value").write.parquet(path)


def load_sparse(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def compressed(coordinates: DataFrame, by: str = "col") -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int]]:
    """(data, indices, indptr, shape) of a matrix of bounded size, compressed by columns or rows."""
    other = "row" if by == "col" else "col"
    rows = coordinates.orderBy(by, other).toPandas()
    shape = (int(rows["row"].max()) + 1, int(rows["col"].max()) + 1) if len(rows) else (0, 0)
    n = shape[1] if by == "col" else shape[0]
    return rows["value"].to_numpy(float), rows[other].to_numpy(), np.searchsorted(rows[by].to_numpy(), np.arange(n + 1)), shape


def from_compressed(spark: SparkSession, data: np.ndarray, indices: np.ndarray, indptr: np.ndarray, by: str = "col") -> DataFrame:
    owner = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    row, col = (indices, owner) if by == "col" else (owner, indices)
    return spark.createDataFrame(pd.DataFrame({"row": row, "col": col, "value": data}), "row long, col long, value double")


def save_npz(coordinates: DataFrame, path: str, by: str = "col", max_entries: int = 50_000_000) -> None:
    """A matrix compressed by columns (csc) or rows (csr) as one ``.npz`` file, of ``max_entries`` entries at most."""
    if coordinates.limit(max_entries + 1).count() > max_entries:
        raise ValueError(f"over {max_entries} entries; save_sparse has no bound")
    data, indices, indptr, shape = compressed(coordinates, by)
    out = io.BytesIO()
    np.savez_compressed(out, data=data, indices=indices, indptr=indptr, shape=np.array(shape), format=np.bytes_("csc" if by == "col" else "csr"))
    write_bytes(coordinates.sparkSession, path, out.getvalue())


def load_npz(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(coordinates, format) of a compressed matrix; its format says whether rows or columns are compressed."""
    with np.load(io.BytesIO(read_bytes(spark, path)), allow_pickle=False) as held:
        kind = held["format"].item()
        kind = kind.decode() if isinstance(kind, bytes) else kind
        if kind not in ("csc", "csr"):
            raise ValueError(f"format {kind!r} isn't a compressed one")
        return from_compressed(spark, held["data"].astype(float), held["indices"].astype(np.int64), held["indptr"].astype(np.int64), "col" if kind == "csc" else "row"), kind
