"""Sorted listings with an explicit position column, top-k and sampling.

``with_position`` numbers a globally sorted result without a single-task
window: the sort is range-partitioned (distributed), each row gets
``monotonically_increasing_id`` (partition index in the upper bits), the
sorted frame is written to the shared folder so both passes see the same
numbering, and one small table of per-partition counts (one row per
partition — a bounded broadcast) turns local indexes into global positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOW_BITS = 33  # monotonically_increasing_id: partition id << 33 | row index


def with_position(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Add the 1-based place of each row in the order of ``order`` as column ``name``.

    The rows come as the sort left them, partition by partition; a caller
    that shows them sorts by ``name``, others save the second global sort.
    """
    from crateflow.session import cut_lineage

    mid = "__wp_mid"
    sorted_df = cut_lineage(df.orderBy(*order).withColumn(mid, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(mid), _LOW_BITS)
    counts = sorted_df.groupBy(part.alias("__wp_part")).agg(F.count(F.lit(1)).alias("__wp_n"))
    # One row per partition: the running sum is a window over a table whose
    # size is bounded by the partition count, not by the data.
    offsets = counts.select(
        "__wp_part", (F.sum("__wp_n").over(Window.orderBy("__wp_part")) - F.col("__wp_n")).alias("__wp_off"))
    local = F.col(mid) - F.shiftleft(part, _LOW_BITS)
    out = (sorted_df.join(F.broadcast(offsets), part == F.col("__wp_part"))
           .withColumn(name, (F.col("__wp_off") + local + 1).cast("bigint"))
           .drop(mid, "__wp_part", "__wp_off"))
    return out


def top_k(df: DataFrame, order: list[Column], k: int, name: str = "pos") -> DataFrame:
    """First ``k`` rows by ``order`` with positions 1..k.

    ``orderBy().limit(k)`` plans as TakeOrderedAndProject (per-partition
    top-k, then a k-row merge); the window runs over those k rows only.
    """
    top = df.orderBy(*order).limit(k)
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def sample_n(df: DataFrame, n: int, seed: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """``n`` rows without replacement (all rows if fewer).

    With a seed and the key columns of a row, the sample is the first ``n``
    rows by the MD5 of seed and keys: the same on every run and engine.
    """
    if seed is None or not keys:
        return df.orderBy(F.rand(seed)).limit(n)
    parts = [F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]]
    return df.orderBy(F.md5(F.concat_ws(":", *parts))).limit(n)
