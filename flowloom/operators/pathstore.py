"""A persistent map from link sequences to trips, kept as Parquet parts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import dense_ids


def encode_key(links: list[int]) -> bytes:
    """Links as unsigned 32-bit numbers from target to source, as stores keep them."""
    return np.array(links[::-1], "<u4").tobytes()


def decode_key(key: bytes) -> list[int]:
    return np.frombuffer(key, "<u4")[::-1].tolist()


def encode_value(trip_id: int) -> bytes:
    return int(trip_id).to_bytes(8, "little")


def decode_value(value: bytes) -> int:
    """The first 32 bits, which both encodings in use (4 and 8 bytes) share."""
    return int.from_bytes(value[:4], "little")


def key_of(links: Column) -> Column:
    """The binary key of a column of links, by hexadecimal digits."""
    one = lambda x: F.lpad(F.hex(x), 8, "0")
    swapped = lambda h: F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    return F.unhex(F.array_join(F.transform(F.reverse(links), lambda x: swapped(one(x))), ""))


def links_of(key: Column) -> Column:
    """The links of a binary key."""
    digits = F.hex(key)
    at = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits), F.lit(8))).otherwise(F.array().cast("array<int>"))
    swapped = lambda i: F.concat(*(F.substr(digits, i + k, F.lit(2)) for k in (6, 4, 2, 0)))
    return F.reverse(F.transform(at, lambda i: F.conv(swapped(i), 16, 10).cast("long")))


SCHEMA = T.StructType([T.StructField("seq", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType()), T.StructField("batch", T.IntegerType())])


class PathStore:
    """Upserts are appended in batches, a folder each; a read takes the last value of each key."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self.path = spark, path
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _batches(self) -> list[int]:
        if not self._fs.exists(self._hadoop):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop)]
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def _rows(self) -> DataFrame:
        if not self._batches():
            return self._spark.createDataFrame([], SCHEMA)
        return self._spark.read.schema(SCHEMA).parquet(self.path)

    def frame(self) -> DataFrame:
        """(key, value): the last value of every key."""
        return self._rows().groupBy("key").agg(F.max_by("value", F.struct("batch", "seq")).alias("value"))

    def upsert(self, rows: DataFrame) -> None:
        """Append (key, value) rows as one batch, which is later than all before; of equal keys in it the last row counts.

        Rows stand in the order of the column ``seq`` if there is one, else in that of the frame.
        """
        seq = F.col("seq").cast("long") if "seq" in rows.columns else F.monotonically_increasing_id()
        batch = max(self._batches(), default=-1) + 1
        rows.select(seq.alias("seq"), "key", "value").write.parquet(f"{self.path}/batch={batch}")

    def add_paths(self, paths: DataFrame) -> None:
        """Append paths (trip_id, links)."""
        value = F.unhex(F.concat(*(F.substring(F.lpad(F.hex("trip_id"), 16, "0"), 15 - 2 * k, 2) for k in range(8))))
        self.upsert(paths.select(key_of(F.col("links")).alias("key"), value.alias("value"), *(c for c in paths.columns if c == "seq")))

    def set(self, key: bytes, value: bytes) -> None:
        self.upsert(self._spark.createDataFrame([(bytearray(key), bytearray(value))], "key binary, value binary"))

    def get(self, key: bytes) -> bytes | None:
        """The value, or None where the key is absent."""
        r = self._rows().where(F.col("key") == F.lit(bytearray(key))).agg(F.max_by("value", F.struct("batch", "seq"))).first()
        return None if r[0] is None else bytes(r[0])

    def scan(self) -> DataFrame:
        """(counter, key, value) in the order of the keys' bytes."""
        return dense_ids(self.frame(), "counter", "key")

    def cursor(self) -> Cursor:
        return Cursor(self)

    def paths(self) -> DataFrame:
        """(trip_id, links) of all keys."""
        digits = F.hex("value")
        trip = F.conv(F.concat(*(F.substring(digits, k, 2) for k in (7, 5, 3, 1))), 16, 10).cast("long")
        return self.frame().select(trip.alias("trip_id"), links_of(F.col("key")).alias("links"))

    def close(self) -> None:
        """Nothing stays open between calls."""

    def destroy(self) -> None:
        self._fs.delete(self._hadoop, True)


class Cursor:
    """Walks a store's keys in order; it stands nowhere until :meth:`reset`."""

    def __init__(self, store: PathStore):
        self._store, self._rows, self._row, self.counter = store, None, None, 0

    def reset(self) -> None:
        self._rows = self._store.frame().orderBy("key").toLocalIterator()
        self.counter = 0
        self._row = next(self._rows, None)

    def is_valid(self) -> bool:
        return self._row is not None

    def next(self) -> None:
        self._row = next(self._rows, None)
        self.counter += 1

    def key(self) -> bytes:
        return bytes(self._row["key"])

    def value(self) -> bytes:
        return bytes(self._row["value"])
