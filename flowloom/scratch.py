"""Cutting lineage in iterative plans by tables in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_left: dict[str, SparkSession] = {}


def root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Only where a local session names none (tests) a temporary one is set; executors on other
    machines wouldn't see it, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="flowloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def folder(spark: SparkSession, label: str) -> str:
    """The path of a new folder that goes when Python ends."""
    path = f"{root(spark)}/flowloom-{label}-{uuid.uuid4().hex}"
    if not _left:
        atexit.register(_clean)
    _left[path] = spark
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table and read back."""
    spark = df.sparkSession
    path = folder(spark, "cut")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*frames: DataFrame | None) -> None:
    """Delete the tables of :func:`cut` that no result depends on any more."""
    for df in frames:
        path = getattr(df, "scratch_path", None)
        if path in _left:
            _delete(_left.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for path, spark in _left.items():
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone when Python ends
            return
