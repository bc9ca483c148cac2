"""Whole texts in slices, and corpus-wide figures of what the slices hold.

A slice is some megabytes of whole rows in one task. It is stored as one row
with its distinct keys (words, id pairs); the keys are counted over the
corpus by Spark (partial aggregation, then a join), and each slice gets the
figures of its own keys back as an array. So the rows that travel are the
distinct keys of slices, not their occurrences, and no task or driver holds
the keys of the corpus.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Numbers(dict):
    """Keys numbered in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def slice_numbers():
    """Numbers for the slices of one task, different from those of all other tasks of the stage."""
    at = TaskContext.get().partitionId() << 32
    while True:
        yield at
        at += 1


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers below 2**32 as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4").astype(np.int64)


def pack_lines(lines: list[str]) -> bytes:
    """Texts without a line end, compressed together."""
    return zstandard.ZstdCompressor(level=3).compress("\n".join(lines).encode())


def unpack_lines(blob: bytes) -> list[str]:
    return zstandard.ZstdDecompressor().decompress(blob).decode().split("\n")


def keys_of_slices(table: DataFrame, key: str, weight: str) -> DataFrame:
    """(slice, at, key, n): one row for each distinct key of each slice; ``at`` is its place in the slice's list."""
    zipped = F.arrays_zip(F.col(key).alias("k"), F.col(weight).alias("n"))
    return table.select("slice", F.posexplode(zipped).alias("at", "e")).select("slice", "at", F.col("e.k").alias("key"),
                                                                            F.col("e.n").alias("n"))


def figures_back(table: DataFrame, keys: DataFrame, figures: DataFrame, columns: list[str]) -> DataFrame:
    """``table`` with ``columns`` of ``figures`` (by key) as arrays in the order of each slice's keys.

    A slice's array is bounded by the slice. Slices without keys get null arrays.
    """
    own = keys.select("slice", "at", "key").join(figures, "key").groupBy("slice").agg(
        F.sort_array(F.collect_list(F.struct("at", *columns))).alias("__own"))
    own = own.select(F.col("slice").alias("__slice"), *(F.col(f"__own.{c}").alias(c) for c in columns))
    return table.join(own, F.col("slice") == F.col("__slice"), "left").drop("__slice")
