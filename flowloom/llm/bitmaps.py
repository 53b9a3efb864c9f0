"""Bitmaps of bounded size for leaving out rows before a join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 25
#: 32 MB, the most that :func:`fitted` makes.
MOST_BITS = 1 << 28


def bitmap(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """The 64-bit numbers of the column ``key`` as ``bits`` bits, which may hold more numbers but lack none."""
    at = F.pmod(F.col("key"), F.lit(bits))
    words = keys.select(at.alias("at")).select(F.expr("at div 64").alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def fitted(keys: DataFrame) -> np.ndarray:
    """A bitmap with 16 bits for each key, as far as its size is bounded."""
    return bitmap(keys, min(MOST_BITS, max(BITS, 1 << (16 * keys.count()).bit_length())))


def held(bits: np.ndarray, keys) -> np.ndarray:
    """Whether the bitmap may hold each key."""
    place = np.asarray(keys).astype(np.int64) % (64 * len(bits))
    return ((bits[place // 64] >> (place % 64).astype(np.uint64)) & np.uint64(1)).astype(bool)


def maybe_in(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose ``key`` may be among ``keys``: all that are, and few others while keys are few."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap(keys))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(held(shared.value, batch["key"].to_numpy(zero_copy_only=False))))

    return rows.mapInArrow(run, rows.schema)
