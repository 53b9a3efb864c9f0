"""Shared pieces of the corpus operators: the scratch folder and text helpers."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only where a local session names none (tests) a temporary folder is set; executors on
    other machines wouldn't see it, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="flowloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_left: list[tuple[SparkSession, str]] = []


def materialize(df: DataFrame, label: str, heavy: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    ``heavy`` asks the JVM to find now what is no longer used, so that Spark deletes the
    shuffle files of jobs before this one, and of this one, while others are still to come.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/flowloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if heavy:
        spark.sparkContext._jvm.System.gc()
    if not _left:
        atexit.register(_clean)
    _left.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete written tables that no result depends on any more."""
    for df in frames:
        path = getattr(df, "scratch_path", None)
        entry = next((x for x in _left if x[1] == path), None)
        if entry:
            _left.remove(entry)
            _delete(*entry)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for entry in _left:
        try:
            _delete(*entry)
        except Exception:  # the JVM may be gone when Python ends
            return


def local_rows(spark: SparkSession, rows: list[dict], schema: dict[str, str]) -> DataFrame:
    """A small table of literals, made by the JVM alone from one string."""
    kind = "array<struct<" + ", ".join(f"`{c}`: {t}" for c, t in schema.items()) + ">>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([{c: r[c] for c in schema} for r in rows])), kind)))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def map_columns(df: DataFrame, run, schema: str) -> DataFrame:
    """``run`` takes record batches and gives columns by name; whole numbers stay exact beside nulls.

    (pandas turns a column of whole numbers with a null into floats, which parts ids of
    more than 53 bits.)  A column is a list, a numpy array or an array of the batch.
    """
    fields = list(to_arrow_schema(StructType.fromDDL(schema)))

    def column(values, kind):
        return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)

    def arrow(batches):
        for found in run(batches):
            yield pa.RecordBatch.from_arrays([column(found[f.name], f.type) for f in fields], [f.name for f in fields])

    return df.mapInArrow(arrow, schema)


def by_name(rows: list[tuple], names: list[str]) -> dict[str, list]:
    """Rows as columns by name."""
    return dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}
