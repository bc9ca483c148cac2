"""Helpers shared by the corpus operators: Arrow slicing, word hashing, scratch tables."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from crateflow.session import scratch_path

#: ASCII white space: what separates words.
SPACES = b" \t\n\x0b\x0c\r"
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACES)] = True


# ---- Spark side ----------------------------------------------------------------------

def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    The cut survives the loss of an executor, and every later branch reads
    the stored rows instead of computing them again.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def extended(df: DataFrame, kept: list[str], more: str) -> StructType:
    """The schema of ``kept`` columns of ``df`` and of ``more`` (DDL)."""
    return StructType([*(df.schema[c] for c in kept), *StructType.fromDDL(more)])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_text(df: DataFrame, kept: list[str], text_col: str) -> tuple[DataFrame, str]:
    """``kept`` columns and the text, and the text's name there: a string column that is kept is not sent twice."""
    if text_col in kept and df.schema[text_col].dataType == StringType():
        return df.select(*kept), text_col
    return df.select(*kept, F.col(text_col).cast("string").alias("__own_text")), "__own_text"


# ---- Arrow side ----------------------------------------------------------------------

def slices(batches, column: str, max_bytes: int):
    """Cut record batches so that ``column`` holds about ``max_bytes`` at most (one row at least).

    A Python worker lives on after its task, next to the executor's heap:
    memory that is free by then goes back to the system.
    """
    for batch in batches:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
        block = np.cumsum(sizes) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    give_back()


def give_back() -> None:
    """Return freed memory of this process to the system, where the allocator can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """The bytes of each text, valid UTF-8 or not."""
    return column.cast(pa.binary()).to_pylist()


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null row is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pa.compute.fill_null(column, b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0]: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of all words of a batch, and where each row's words begin (one entry more than rows)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    stop = inside
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


_BASE = np.uint64(0x9E3779B97F4A7C13)  # odd, 3 modulo 4
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


@functools.cache
def _byte_values(salt: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(salt)).integers(0, 2**64, 256, dtype=np.uint64)


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        inverse = pow(int(base), -1, 2**64)
        with np.errstate(over="ignore"):
            have = tuple(np.concatenate([[np.uint64(1)], np.full(size - 1, b, dtype=np.uint64)]).cumprod(dtype=np.uint64)
                         for b in (base, np.uint64(inverse)))
        _POWERS[int(base)] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, block: int = 1 << 18,
                salt: int = 0) -> np.ndarray:
    """A 64-bit hash for each word, by prefix sums of a polynomial over the bytes.

    The sums run over blocks of about ``block`` bytes, so that memory stays
    bounded however long a text is.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(stops, starts[a] + block, side="right")))
        lo, hi = int(starts[a]), int(stops[b - 1])
        up, down = powers(_BASE, hi - lo + 1)
        sums = np.empty(hi - lo + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_byte_values(salt)[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = starts[a:b] - lo, stops[a:b] - lo
        out[a:b] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        a = b
    return out


def window_hashes(words: np.ndarray, length: int, base: np.uint64 = np.uint64(0xC2B2AE3D27D4EB4F)) -> np.ndarray:
    """Rabin-Karp hash of every ``length`` consecutive entries of ``words``."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(base, len(words) + 1)
    sums = np.empty(len(words) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[length:] - sums[:n]) * down[:n])

