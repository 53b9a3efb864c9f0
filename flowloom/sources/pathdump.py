"""Path dumps: gzip of unsigned 32-bit numbers; a record is a trip, its links and an end mark."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.pathstore import PathStore
from .ranged import files_of, qualified, system
from .tntp import filled, lines

END = 0xFFFFFFFF
PATHS = "trip_id long, links array<long>"
#: Bytes that are read or inflated at once; a task holds a few times as many and the record that it is in.
CHUNK = 1 << 20
SUFFIX = ".bin.gz"


def inflate(stream, chunk: int = CHUNK) -> Iterator[bytes]:
    """The contents of a gzip stream of any number of members, in pieces of at most ``chunk`` bytes; a cut one raises."""
    member = zlib.decompressobj(31)
    begun = False
    while data := stream.read(chunk):
        while data:
            if member.eof:
                member, begun = zlib.decompressobj(31), False
            begun = True
            piece = member.decompress(data, chunk)
            if piece:
                yield piece
            data = member.unused_data if member.eof else member.unconsumed_tail
    while begun and not member.eof:
        piece = member.decompress(member.unconsumed_tail, chunk)
        if not piece:
            raise ValueError("the dump ends within its compressed data")
        yield piece


def whole_records(pieces: Iterator[bytes]) -> Iterator[np.ndarray]:
    """The numbers of the pieces, cut after end marks; a last record without its mark raises."""
    held: list[bytes] = []
    size, tail = 0, b""  # bytes held and the last of them
    for piece in pieces:
        odd = size % 4
        data = np.frombuffer(piece, np.uint8)
        # The numbers that lie wholly in this piece, and the one that began before it.
        start = (4 - odd) % 4
        body = data[start : start + (len(data) - start) // 4 * 4].tobytes() if len(data) >= start else b""
        marks = np.flatnonzero(np.frombuffer(body, "<u4") == END)
        split = tail[-odd:] + piece[:start] if odd and len(data) >= start else b""
        cut = start + 4 * (int(marks[-1]) + 1) if len(marks) else start if split == b"\xff" * 4 else 0
        if cut:
            yield np.frombuffer(b"".join([*held, piece[:cut]]), "<u4")
            held, size = [], 0
        held.append(piece[cut:])
        size += len(piece) - cut
        tail = (tail + piece)[-3:]
    if size:
        raise ValueError("the dump ends within a record")


def batch_of(values: np.ndarray) -> pa.RecordBatch:
    """The records (trip_id, links) of whole records' numbers; one without a trip raises."""
    ends = np.flatnonzero(values == END)
    starts = np.concatenate([[0], ends[:-1] + 1])
    if (starts == ends).any():
        raise ValueError("a record has no trip")
    links = np.ones(len(values), bool)
    links[starts] = links[ends] = False
    offsets = np.concatenate([[0], np.cumsum(ends - starts - 1)]).astype(np.int32)
    made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[links].astype(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(values[starts].astype(np.int64)), made], ["trip_id", "links"])


def numbers_of(batch: pa.RecordBatch) -> bytes:
    """The records of paths (trip_id, links); nulls and ids that don't fit raise."""
    trips, links = batch.column("trip_id"), batch.column("links")
    if trips.null_count or links.null_count or links.flatten().null_count:
        raise ValueError("a dump holds no nulls")
    trips, flat = trips.to_numpy(), links.flatten().to_numpy()
    sizes = links.value_lengths().to_numpy().astype(np.int64)
    if any(len(x) and (x.min() < 0 or x.max() >= END) for x in (trips, flat)):
        raise ValueError("an id doesn't fit in a dump")
    starts = np.concatenate([[0], np.cumsum(sizes + 2)])
    out = np.full(starts[-1], END, "<u4")
    own = np.ones(len(out), bool)
    own[starts[:-1]] = own[starts[1:] - 1] = False
    out[starts[:-1]] = trips
    out[own] = flat
    return out.tobytes()


@dataclass
class Dump(InputPartition):
    """A file, which one task reads: gzip has no places to begin at."""

    uri: str


@dataclass
class Written(WriterCommitMessage):
    """The file that a task has written, None if it had no rows."""

    name: str | None


class PathDumpSource(DataSource):
    """``format("pathdump")``: reads dumps or folders of dumps, writes a dump for each task.

    Options of reading: ``number_of_links`` and ``number_of_trips``, ids beyond which raise.
    """

    @classmethod
    def name(cls) -> str:
        return "pathdump"

    def schema(self) -> str:
        return PATHS

    def reader(self, schema: StructType) -> PathDumpReader:
        return PathDumpReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> PathDumpWriter:
        return PathDumpWriter(self.options["path"], overwrite)


class PathDumpReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.bounds = {c: int(options[k]) for c, k in (("links", "number_of_links"), ("trip_id", "number_of_trips")) if k in options}

    def partitions(self) -> list[Dump]:
        return [Dump(f) for p in self.paths for f in files_of(p)]

    def read(self, partition: Dump | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        fs, path = system(partition.uri)
        with fs.open_input_stream(path, compression=None) as stream:
            for values in whole_records(inflate(stream)):
                batch = batch_of(values)
                for column, bound in self.bounds.items():
                    held = batch.column(column)
                    held = (held.flatten() if column == "links" else held).to_numpy()
                    if len(held) and held.max() >= bound:
                        raise ValueError(f"{partition.uri} holds the {column} {held.max()}, which is out of range")
                yield batch


class PathDumpWriter(DataSourceArrowWriter):
    """Tasks write beside the dumps; what the job commits is moved among them, so lost and repeated tasks leave nothing."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def _beside(self, root: str) -> str:
        return f"{root}/_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = system(self.path)
        name = out = None
        packed = zlib.compressobj(6, zlib.DEFLATED, 31)
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                name = uuid.uuid4().hex + SUFFIX
                fs.create_dir(self._beside(root), recursive=True)
                out = fs.open_output_stream(f"{self._beside(root)}/{name}", compression=None)
            out.write(packed.compress(numbers_of(batch)))
        if out is not None:
            out.write(packed.flush())
            out.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = system(self.path)
        fs.create_dir(root, recursive=True)
        old = [system(f)[1] for f in files_of(self.path) if f.endswith(SUFFIX)] if self.overwrite else []
        for i, m in enumerate(messages):
            if m is not None and m.name:
                fs.move(f"{self._beside(root)}/{m.name}", f"{root}/part-{i:05d}-{self.job}{SUFFIX}")
        for path in old:
            fs.delete_file(path)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = system(self.path)
        fs.delete_dir_contents(self._beside(root), missing_dir_ok=True)
        if fs.get_file_info(self._beside(root)).type.name == "Directory":
            fs.delete_dir(self._beside(root))


def read_paths(spark: SparkSession, *paths: str, number_of_links: int | None = None, number_of_trips: int | None = None) -> DataFrame:
    """(trip_id, links) of dumps and folders of dumps, a task a file, in bounded memory; ids beyond the given numbers raise."""
    spark.dataSource.register(PathDumpSource)
    read = spark.read.format("pathdump")
    for key, bound in (("number_of_links", number_of_links), ("number_of_trips", number_of_trips)):
        if bound is not None:
            read = read.option(key, bound)
    return read.load([qualified(spark, p) for p in paths])


def write_paths(paths: DataFrame, folder: str, mode: str = "append") -> None:
    """A folder of dumps, one for each task of paths (trip_id, links) that has rows; ``mode`` is append or overwrite."""
    spark = paths.sparkSession
    spark.dataSource.register(PathDumpSource)
    found = paths.select(F.col("trip_id").cast("long"), F.col("links").cast("array<long>"))
    found.write.format("pathdump").mode(mode).save(qualified(spark, folder))


def load_into(store: PathStore, paths: DataFrame) -> None:
    """Upsert the paths of dumps into a store."""
    store.add_paths(paths)


def parse_sequences(text: str) -> list:
    """Nested sequences of whole numbers in YAML, in flow style (``[0, [1]]``) or block style (``- 0``)."""
    if text.lstrip().startswith("["):
        return json.loads(text)
    top: list = []
    open_: list[tuple[int, list]] = [(-1, top)]  # (column of its dashes, sequence)
    for line in text.splitlines():
        at = len(line) - len(line.lstrip(" "))
        rest = line[at:].rstrip()
        if not rest or rest.startswith(("#", "---")):
            continue
        while rest.startswith("-"):
            while open_[-1][0] > at:
                open_.pop()
            if open_[-1][0] < at:
                inner: list = []
                open_[-1][1].append(inner)
                open_.append((at, inner))
            body = rest[1:].lstrip(" ")
            at, rest = at + len(rest) - len(body), body
        if rest:
            open_[-1][1].append(json.loads(rest))
    return top[0] if top else []


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """(source, target, links) of legacy listings in block style, read by line in splits.

    The layout is that of :func:`parse_sequences` with the usual indentation: sources at the first
    column, targets below them, links in flow style (``- [0, 2]``) or one a line.  A line's source and
    target are the last ones before it, also where those stand in an earlier split.
    """
    rows = lines(spark, path)
    line = F.col("line")
    source, target = r"^- - (\d+)\s*$", r"^  (?:- -|  -) - (\d+)\s*$"

    def number(pattern: str):
        return F.when(line.rlike(pattern), F.regexp_extract(line, pattern, 1).cast("long"))

    # Both in one struct each, so that a target's place tells apart two paths of one trip.
    rows = filled(rows, number(source), "source")
    opened = F.when(line.rlike(target), F.struct(F.regexp_extract(line, target, 1).cast("long").alias("target"), F.col("pos")))
    rows = filled(rows, opened, "at")
    flow, first, more = r"^      - \[(.*)\]\s*$", r"^      - - (\d+)\s*$", r"^        - (\d+)\s*$"
    listed = F.when(F.trim(F.regexp_extract(line, flow, 1)) != "", F.split(F.regexp_extract(line, flow, 1), ",").cast("array<string>")).otherwise(F.array().cast("array<string>"))
    own = F.when(line.rlike(flow), F.transform(listed, lambda x: F.trim(x).cast("long"))).when(line.rlike(first), F.array(number(first))).when(line.rlike(more), F.array(number(more)))
    held = rows.select("file", "source", "at", "pos", own.alias("own")).where("own is not null")
    found = held.groupBy("file", "source", "at").agg(F.sort_array(F.collect_list(F.struct("pos", "own"))).alias("own"))
    return found.select("source", "at.target", F.flatten("own.own").alias("links"))


def listing_lines(paths: DataFrame) -> DataFrame:
    """(value): paths (source, target, links) as entries of a listing, to be written as text."""
    entry = F.concat(F.lit("- - "), "source", F.lit("\n  - - - "), "target", F.lit("\n      - ["), F.array_join(F.transform("links", lambda x: x.cast("string")), ", "), F.lit("]"))
    return paths.select(entry.alias("value"))


def read_tries(spark: SparkSession, contents: str) -> DataFrame:
    """(source, target, links) of the legacy listing ``[source, [[target, [links]], ...]]`` for each source."""
    rows = [(s, t, links) for s, targets in parse_sequences(contents) for t, links in targets]
    return spark.createDataFrame(rows, "source long, target long, links array<long>")


def display(paths: DataFrame, n: int = 20) -> list[str]:
    """The first ``n`` paths (source, target, links) as lines, in order."""
    rows = paths.orderBy("source", "target", "links").limit(n).collect()
    return [f"{r['source']} -> {r['target']}: {' '.join(map(str, r['links']))}" for r in rows]
