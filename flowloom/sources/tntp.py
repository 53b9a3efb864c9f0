"""TNTP text files: networks, trips and solutions.

Files are read in splits, many tasks to a large file.  A line's place is its split's byte offset
and its number within the task that reads it, which orders the lines of a file without
bringing them together.  What a line needs of earlier ones (where the header ends, the origin
of a trip, how many lines came before) is found for each split and carried over by the splits'
one row each.
"""

from __future__ import annotations

import posixpath
import re
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cost import Bpr, LinkCost
from ..operators.graph import dense_ids
from ..scratch import cut
from ..schema import TNTP_LINK, TNTP_SOLUTION

END = "<END OF METADATA>"
ENTRY = re.compile(r"<(.*)>\s+(.*)")
# The keys of the format.
ZONES, NODES, LINKS, FIRST_THRU, TOTAL_FLOW = "NUMBER OF ZONES", "NUMBER OF NODES", "NUMBER OF LINKS", "FIRST THRU NODE", "TOTAL OD FLOW"


#: Up to so many files or splits their rows are broadcast (some 20 MB); beyond, lines are joined with them by shuffling.
MAX_BESIDE = 100_000


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, line) of the files of a path, ``pos`` a struct (block, number) that orders the lines of a file.

    Lines end with ``\\n``, ``\\r\\n`` or ``\\r``; an empty file has none.  Numbers are consecutive
    within a block, but don't begin at zero.
    """
    pos = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("number"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), pos.alias("pos"), F.col("value").alias("line"))


def lines_of(spark: SparkSession, contents: str) -> DataFrame:
    """The same of a text."""
    whole = spark.createDataFrame([("", contents)], "file string, value string")
    body = F.regexp_replace(F.regexp_replace("value", r"\r\n?", "\n"), r"\n$", "")
    pos = F.struct(F.lit(0).cast("long").alias("block"), F.col("at").cast("long").alias("number"))
    return whole.select("file", F.posexplode(F.split(body, "\n", -1)).alias("at", "line")).select("file", pos.alias("pos"), "line")


def _beside(rows: DataFrame, few: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with the columns of a table that has one row for each file or split."""
    few = cut(few)
    return rows.join(F.broadcast(few) if few.count() <= MAX_BESIDE else few, list(keys), "left")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`lines` with ``row``, their number in their file from 0 on."""
    blocks = rows.groupBy("file", F.col("pos.block").alias("_block")).agg(F.min("pos.number").alias("_least"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    first = blocks.select("file", "_block", (F.coalesce(before, F.lit(0)) - F.col("_least")).alias("_shift"))
    found = _beside(rows.withColumn("_block", F.col("pos.block")), first, "file", "_block")
    return found.withColumn("row", F.col("pos.number") + F.col("_shift")).drop("_block", "_shift")


def filled(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``rows`` with the last ``value`` that isn't null up to each line of its file.

    Within a split it is a window; between splits the last value of each is carried on.
    """
    rows = rows.withColumn(name, value).withColumn("_block", F.col("pos.block"))
    last = rows.groupBy("file", "_block").agg(F.max_by(name, F.when(F.col(name).isNotNull(), F.col("pos"))).alias("_last"))
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("file", "_block", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    within = F.last(name, ignorenulls=True).over(Window.partitionBy("file", "_block").orderBy("pos.number"))
    return _beside(rows.withColumn(name, within), carried, "file", "_block").withColumn(name, F.coalesce(name, "_carried")).drop("_block", "_carried")


def is_metadata(line: Column) -> Column:
    return line.startswith("<")


def is_end_of_metadata(line: Column) -> Column:
    return line == END


def is_comment(line: Column) -> Column:
    return line.startswith("~")


def is_empty(line: Column) -> Column:
    return F.length(F.regexp_replace(line, r"\s", "")) == 0


def is_header(line: Column) -> Column:
    return is_metadata(line) | is_comment(line) | is_empty(line)


def is_numeric(text: Column) -> Column:
    return text.try_cast("double").isNotNull()


def metadata(rows: DataFrame) -> DataFrame:
    """(file, key, value) of the leading lines ``<KEY> value`` up to the end mark.

    Lines without white space after the key are skipped; of a repeated key the last counts.
    """
    stop = F.min(F.when(~is_metadata(F.col("line")) | is_end_of_metadata(F.col("line")), F.col("pos"))).alias("_stop")
    head = _beside(rows, rows.groupBy("file").agg(stop), "file").where(F.col("_stop").isNull() | (F.col("pos") < F.col("_stop")))
    pattern = r"^<(.*)>\s+(.*)"
    parsed = head.where(F.col("line").rlike(pattern)).select("file", "pos", F.regexp_extract("line", pattern, 1).alias("key"), F.regexp_extract("line", pattern, 2).alias("value"))
    return parsed.groupBy("file", "key").agg(F.max_by("value", "pos").alias("value"))


def metadata_dict(contents: str) -> dict[str, str]:
    """The metadata of a text on the driver, with a warning for each line that can't be read."""
    out = {}
    for line in contents.splitlines():
        if not line.startswith("<") or line == END:
            break
        m = ENTRY.match(line)
        if m:
            out[m[1]] = m[2]
        else:
            warnings.warn(f"metadata line can't be read: {line}", stacklevel=2)
    return out


def _value(key: str, kind: str) -> Column:
    return F.max(F.when(F.col("key") == key, F.trim("value").try_cast(kind)))


def network_metadata(rows: DataFrame) -> DataFrame:
    """(file, n_zones, n_nodes, n_links, first_node), null where a key is missing."""
    files = rows.select("file").distinct()
    found = metadata(rows).groupBy("file").agg(_value(ZONES, "int").alias("n_zones"), _value(NODES, "int").alias("n_nodes"), _value(LINKS, "int").alias("n_links"), _value(FIRST_THRU, "int").alias("first_node"))
    return files.join(found, "file", "left")


def trips_metadata(rows: DataFrame) -> DataFrame:
    """(file, n_zones, total_flow), null where a key is missing."""
    files = rows.select("file").distinct()
    return files.join(metadata(rows).groupBy("file").agg(_value(ZONES, "int").alias("n_zones"), _value(TOTAL_FLOW, "double").alias("total_flow")), "file", "left")


def body(rows: DataFrame) -> DataFrame:
    """The lines from the first that isn't header on, without empty ones."""
    first = rows.where(~is_header(F.col("line"))).groupBy("file").agg(F.min("pos").alias("_first"))
    return _beside(rows, first, "file").where((F.col("pos") >= F.col("_first")) & ~is_empty(F.col("line"))).drop("_first")


def parse_links(rows: DataFrame) -> DataFrame:
    """Body lines as link records: tab-separated, ``;`` at the end, further fields ignored; bad values raise."""
    clean = F.regexp_replace(F.regexp_replace("line", r"^;+|;+$", ""), r"^\s+|\s+$", "")
    clean = F.regexp_replace(F.regexp_replace(clean, r";+$", ""), r"\s+$", "")
    fields = F.split(clean, "\t", -1)
    return rows.select("file", "pos", *(F.trim(F.element_at(fields, i + 1)).cast(f.dataType).alias(f.name) for i, f in enumerate(TNTP_LINK)))


def read_network(rows: DataFrame) -> DataFrame:
    """Links with link_id by (from_node, to_node) and, of equals, by place."""
    return dense_ids(parse_links(body(rows)), "link_id", "file", "from_node", "to_node", "pos").drop("pos", "file")


def first_link_bpr(links: DataFrame) -> LinkCost:
    """BPR with alpha and beta of the first link, for all links."""
    r = links.orderBy("link_id").select("b", "power").first()
    return Bpr(alpha=float(r["b"]), beta=float(r["power"]))


def read_trips(rows: DataFrame) -> DataFrame:
    """(seq, origin, destination, volume) of ``Origin N`` blocks, sorted; volumes of zero go, trips within a zone stay."""
    own = F.when(F.col("line").rlike(r"^\s*Origin\s"), F.regexp_extract("line", r"Origin\s+(\d+)", 1).cast("int"))
    known = filled(body(rows), own, "origin").where(~F.col("line").rlike(r"^\s*Origin\s") & F.col("origin").isNotNull())
    items = known.select("file", "origin", F.explode(F.split("line", ";")).alias("item")).where(F.trim("item") != "")
    parts = F.split("item", ":")
    trips = items.select("file", "origin", F.trim(parts[0]).cast("int").alias("destination"), F.trim(parts[1]).cast("double").alias("volume")).where("volume > 0")
    return dense_ids(trips, "seq", "file", "origin", "destination", "volume").drop("file")


def read_solution(rows: DataFrame) -> DataFrame:
    """(link_id, origin, destination, volume, cost) of the lines whose first field is a number, sorted."""
    fields = F.split(F.regexp_replace(F.regexp_replace("line", r"[;\s]+$", ""), r"^\s+", ""), "\t", -1)
    data = rows.where(is_numeric(F.trim(F.split("line", "\t")[0])))
    found = data.select("file", *(F.trim(F.element_at(fields, i + 1)).cast(f.dataType).alias(f.name) for i, f in enumerate(TNTP_SOLUTION)))
    return dense_ids(found, "link_id", "file", "origin", "destination", "volume", "cost").drop("file")


def solution_flow(solution: DataFrame) -> DataFrame:
    return solution.select("link_id", F.col("volume").alias("flow"))


def solution_cost(solution: DataFrame) -> DataFrame:
    return solution.select("link_id", "cost")


@dataclass(frozen=True)
class Directory:
    """A folder ``name`` with the files ``name_net``, ``name_trips`` and ``name_flow``."""

    path: str

    def name(self) -> str:
        return posixpath.basename(self.path.rstrip("/"))

    def path_of(self, kind: str) -> str:
        """``kind``: net, trips or flow."""
        if kind not in ("net", "trips", "flow"):
            raise ValueError(f"no file of kind {kind!r}")
        return f"{self.path.rstrip('/')}/{self.name()}_{kind}.tntp"

    def network(self, spark: SparkSession) -> DataFrame:
        return read_network(lines(spark, self.path_of("net")))

    def trips(self, spark: SparkSession) -> DataFrame:
        return read_trips(lines(spark, self.path_of("trips")))

    def solution(self, spark: SparkSession) -> DataFrame:
        return read_solution(lines(spark, self.path_of("flow")))
