"""ESRI shapefiles: geometry (.shp) and attributes (.dbf), after the published formats.

A shapefile is read in ranges of records, many tasks to a file: attributes have a fixed width, and
the index (.shx) tells the place of each shape.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.roads import capacity, free_flow_time, is_link, is_virtual
from ..operators.graph import centroids, dense_ids, encode_links, largest_component, last_parallel, nearest_nodes, out_degree, within
from .ranged import qualified, system

RECORDS = "part int, live long, deleted boolean, properties map<string,string>, geometry array<struct<x:double,y:double>>"
DEFAULT_NODES, DEFAULT_LINKS = "node.shp", "link.shp"
#: Records of a task, unless the option ``records`` says otherwise.  The format holds at most 2 ** 32, so there are at most 43,000 tasks.
RECORDS_PER_PART = 100_000
#: Records that are read and handed on at once.
BLOCK = 1024

POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
PROPERTIES = pa.map_(pa.string(), pa.string())


@dataclass
class Table:
    """The head of a .dbf file: records, where they begin, their width, and the fields' names and widths."""

    count: int
    head: int
    size: int
    fields: list[tuple[str, int]]


def table_head(data: bytes) -> Table:
    count, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32
    return Table(count, head, size, fields)


def record_values(row: bytes, fields: list[tuple[str, int]]) -> list[tuple[str, str | None]]:
    """The fields as trimmed text; empty ones are None."""
    out, k = [], 1
    for name, width in fields:
        out.append((name, row[k : k + width].decode("latin-1").strip() or None))
        k += width
    return out


def shape_points(body: bytes) -> np.ndarray:
    """The (x, y) of a shape: one of a point, all parts' of a line; null shapes have none."""
    (kind,) = struct.unpack_from("<i", body)
    if kind % 10 == 1:
        return np.frombuffer(body, "<f8", 2, 4).reshape(1, 2)
    if kind % 10 in (3, 5):
        parts, points = struct.unpack_from("<2i", body, 36)
        return np.frombuffer(body, "<f8", 2 * points, 44 + 4 * parts).reshape(points, 2)
    return np.empty((0, 2))


@dataclass
class Records(InputPartition):
    """The records of a task, from ``first`` up to ``last``."""

    part: int
    first: int
    last: int


class ShapefileSource(DataSource):
    """``spark.read.format("shapefile")`` for one path (with or without its extension).

    Each record has ``part``, the number of its task, and ``live``, its place among those of the
    task that aren't deleted (null for deleted ones).  A schema of fewer columns reads less: without
    ``geometry`` the shapes stay unread, without ``properties`` the attributes aren't taken
    apart; the option ``fields`` (names, comma-separated) keeps only these.  Without an index the shapes are
    found one after the other, by one task.
    """

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema: StructType) -> ShapefileReader:
        return ShapefileReader(schema.fieldNames(), dict(self.options))


class ShapefileReader(DataSourceReader):
    def __init__(self, columns: list[str], options: dict[str, str]) -> None:
        path = options["path"]
        self.columns = columns
        self.stem = path[:-4] if path.lower().endswith(".shp") else path
        self.size = int(options.get("records", RECORDS_PER_PART))
        self.chosen = [f.strip() for f in options["fields"].split(",")] if "fields" in options else None

    def _open(self, extension: str):
        fs, path = system(self.stem + extension)
        return fs.open_input_file(path)

    def _table(self) -> Table:
        with self._open(".dbf") as f:
            (head,) = struct.unpack("<H", f.read_at(2, 8))
            return table_head(f.read_at(head, 0))

    def _indexed(self) -> bool:
        fs, path = system(self.stem + ".shx")
        return fs.get_file_info(path).is_file

    def partitions(self) -> list[Records]:
        count, size = self._table().count, self.size
        if "geometry" in self.columns:
            if self._indexed():
                with self._open(".shx") as f:
                    if (f.size() - 100) // 8 != count:
                        raise ValueError(f"{self.stem} has {count} records and {(f.size() - 100) // 8} shapes")
            else:
                size = max(count, 1)
        return [Records(i, a, min(a + size, count)) for i, a in enumerate(range(0, count, size))]

    def _shapes(self, first: int, last: int) -> Iterator[list[np.ndarray]]:
        """The points of the records, in blocks; those of a block are read at once where they stand together."""
        with self._open(".shp") as shp:
            if not self._indexed():
                yield from self._one_by_one(shp, last)
                return
            with self._open(".shx") as shx:
                for a in range(first, last, BLOCK):
                    index = np.frombuffer(shx.read_at(8 * (min(a + BLOCK, last) - a), 100 + 8 * a), ">i4").astype(np.int64).reshape(-1, 2) * 2
                    least, most = int(index[:, 0].min()), int(index.sum(axis=1).max()) + 8
                    if most - least <= 2 * int(index[:, 1].sum()) + 16 * BLOCK:
                        data = shp.read_at(most - least, least)
                        yield [shape_points(data[o - least + 8 : o - least + 8 + n]) for o, n in index.tolist()]
                    else:
                        yield [shape_points(shp.read_at(n, o + 8)) for o, n in index.tolist()]

    def _one_by_one(self, shp, count: int) -> Iterator[list[np.ndarray]]:
        at, out, found = 100, [], 0
        while at + 8 <= shp.size():
            (words,) = struct.unpack(">I", shp.read_at(4, at + 4))
            out.append(shape_points(shp.read_at(2 * words, at + 8)))
            at += 8 + 2 * words
            found += 1
            if len(out) == BLOCK:
                yield out
                out = []
        if found != count:
            raise ValueError(f"{self.stem} has {count} records and {found} shapes")
        yield out

    def read(self, partition: Records | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no records, so no partitions
            return
        table = self._table()
        kept = None if self.chosen is None else set(self.chosen)
        shapes = self._shapes(partition.first, partition.last) if "geometry" in self.columns else None
        live = 0
        with self._open(".dbf") as dbf:
            for a in range(partition.first, partition.last, BLOCK):
                n = min(a + BLOCK, partition.last) - a
                data = dbf.read_at(n * table.size, table.head + a * table.size)
                if len(data) != n * table.size:
                    raise ValueError(f"{self.stem}.dbf ends before its record {a + n}")
                gone = np.frombuffer(data, np.uint8)[:: table.size] == ord("*")
                places = live + np.cumsum(~gone) - 1
                live += int((~gone).sum())
                made = {"part": pa.array(np.full(n, partition.part, np.int32)), "live": pa.array(places, pa.int64(), mask=gone), "deleted": pa.array(gone)}
                if "properties" in self.columns:
                    rows = (record_values(data[i * table.size : (i + 1) * table.size], table.fields) for i in range(n))
                    made["properties"] = pa.array([r if kept is None else [v for v in r if v[0] in kept] for r in rows], PROPERTIES)
                if shapes is not None:
                    points = next(shapes)
                    ends = np.cumsum([0, *map(len, points)], dtype=np.int32)
                    flat = np.concatenate(points)
                    xy = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["x", "y"])
                    made["geometry"] = pa.ListArray.from_arrays(pa.array(ends), xy)
                yield pa.RecordBatch.from_arrays([made[c] for c in self.columns], self.columns)
        if shapes is not None:
            next(shapes, None)  # counts what is left where there is no index


def records(spark: SparkSession, path: str, schema: str = RECORDS, per_part: int = RECORDS_PER_PART, fields: list[str] | None = None) -> DataFrame:
    """The records of a shapefile as :class:`ShapefileSource` gives them."""
    spark.dataSource.register(ShapefileSource)
    read = spark.read.format("shapefile").schema(schema).option("records", per_part)
    return (read.option("fields", ",".join(fields)) if fields else read).load(qualified(spark, path))


def features(spark: SparkSession, path: str, per_part: int = RECORDS_PER_PART, fields: list[str] | None = None) -> DataFrame:
    """(record, properties, geometry) of a shapefile; ``record`` is its place among those that aren't deleted.

    Places within tasks are shifted by the records of the tasks before, whose counts are one row a
    task (at most 43,000 at the default).  An empty file has no rows.
    """
    counts = records(spark, path, "part int, deleted boolean", per_part).groupBy("part").agg(F.count_if(~F.col("deleted")))
    before, total = [], 0
    held = dict(counts.collect())
    # Without an index the shapes are one task, whose places need no shift.
    for part in sorted(held):
        before.append((part, total))
        total += held[part]
    shift = F.broadcast(spark.createDataFrame(before, "part int, _before long"))
    found = records(spark, path, per_part=per_part, fields=fields).where("not deleted")
    return found.join(shift, "part").select((F.col("live") + F.col("_before")).alias("record"), "properties", "geometry")


def prop(name: str, kind: str = "double") -> Column:
    value = F.col("properties")[name]
    return value.cast("double").cast(kind) if kind in ("int", "long") else value.cast(kind)


def nodes_of(found: DataFrame) -> DataFrame:
    """(node_id, name, x, y): ids by place, x the latitude and y the longitude."""
    return found.select(F.col("record").alias("node_id"), prop("ID", "long").alias("name"), prop("LAT").alias("x"), prop("LON").alias("y"))


def directed_links(found: DataFrame) -> DataFrame:
    """(seq, id, length, speed, capacity, zone, lanes, from_point, to_point, geometry): two for each record.

    Each direction has its own speed, clipped capacity, zone and lanes; the second one's
    geometry is reversed.
    """
    a = F.struct(prop("LAT1").alias("x"), prop("LON1").alias("y"))
    b = F.struct(prop("LAT2").alias("x"), prop("LON2").alias("y"))

    def way(side: str, start: Column, end: Column, geometry: Column) -> Column:
        return F.struct(
            prop("ID_1", "long").alias("id"),
            prop("LENGTH").alias("length"),
            prop(f"{side}_SPEED").alias("speed"),
            capacity(prop(f"{side}_CAPACIT")).alias("capacity"),
            prop(f"{side}_ZONE", "long").alias("zone"),
            prop(f"{side}_LANES", "long").alias("lanes"),
            start.alias("from_point"),
            end.alias("to_point"),
            geometry.alias("geometry"),
        )

    both = F.array(way("AB", a, b, F.col("geometry")), way("BA", b, a, F.reverse("geometry")))
    return found.select("record", F.posexplode(both).alias("way", "link")).select((F.col("record") * 2 + F.col("way")).alias("seq"), "link.*")


def extended(links: DataFrame, corrected: bool = False) -> DataFrame:
    """The derived attributes is_link, is_virtual and free_flow_time."""
    return links.withColumns({"is_link": is_link(F.col("lanes")), "is_virtual": is_virtual(F.col("capacity")), "free_flow_time": free_flow_time(F.col("length"), F.col("speed"), corrected)})


def build_network(nodes: DataFrame, links: DataFrame, cell: float = 0.01) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, links, zones) of the largest strongly connected part of a road network.

    Links that exist snap to the nearest nodes; of parallel ones the last counts, at the
    place of the first.  Nodes are numbered anew in order, links by place.  A zone's node
    is the one that its connectors share.
    """
    alive = extended(links).where("is_link")
    ends = alive.select(F.explode(F.array("from_point", "to_point")).alias("p")).select("p.x", "p.y").distinct()
    points = dense_ids(ends, "point_id", "x", "y")
    snapped = nearest_nodes(points, nodes, cell).select("x", "y", "node_id")
    u = snapped.select(F.struct("x", "y").alias("from_point"), F.col("node_id").alias("u"))
    v = snapped.select(F.struct("x", "y").alias("to_point"), F.col("node_id").alias("v"))
    placed = alive.join(u, "from_point").join(v, "to_point")
    single = last_parallel(placed, "seq")
    index = largest_component(single)
    kept = within(single, index)
    numbered = dense_ids(kept, "link_id", "seq").drop("seq")
    zone_links = encode_links(placed.where("is_virtual").select("zone", "u", "v"), index, "u", "v")
    zones = centroids(zone_links, out_degree(numbered))
    old = index.select(F.col("node").alias("node_id"), F.col("node_id").alias("_new"))
    return nodes.join(old, "node_id").select(F.col("_new").alias("node_id"), "name", "x", "y"), numbered, zones


def read_network(spark: SparkSession, directory: str, node_file: str = DEFAULT_NODES, link_file: str = DEFAULT_LINKS, cell: float = 0.01) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, links, zones) of the shapefiles in a folder."""
    nodes = nodes_of(features(spark, f"{directory}/{node_file}"))
    return build_network(nodes, directed_links(features(spark, f"{directory}/{link_file}")), cell)
