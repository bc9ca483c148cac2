"""Nesting helpers: rows -> one array<struct> per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nest_by_key(df: DataFrame, key: str | list[str], name: str, fields: list[str] | None = None,
                sort: bool = True) -> DataFrame:
    """Group ``df`` by ``key`` and collect the remaining (or given) fields.

    The key is removed from the nested structs. ``collect_list`` is partially
    aggregated map-side; one group holds the rows of one key only, which is
    the output record itself. ``sort`` orders each array for determinism.
    """
    keys = [key] if isinstance(key, str) else list(key)
    fields = fields or [c for c in df.columns if c not in keys]
    arr = F.collect_list(F.struct(*fields))
    if sort:
        arr = F.array_sort(arr)
    return df.groupBy(*keys).agg(arr.alias(name))


def nest_in_parts(df: DataFrame, key: str, name: str, size: int, fields: list[str] | None = None) -> DataFrame:
    """(key, part, ``name``): a key's rows in their order, ``size`` to a part; part 0 comes first.

    No output row holds more than ``size`` of them, however many one key has:
    the rows are numbered by one distributed sort (a hot key spans several of
    its ranges) and grouped by key and part.
    """
    from crateflow.operators.ordering import with_position

    fields = fields or [c for c in df.columns if c != key]
    rows = with_position(df.select(key, *fields), [F.col(key).asc(), *(F.col(f).asc_nulls_first() for f in fields)], "__at")
    first = rows.groupBy(F.col(key).alias("__key")).agg(F.min("__at").alias("__first"))
    part = F.floor((F.col("__at") - F.col("__first")) / size).cast("int")
    rows = rows.join(first, F.col(key).eqNullSafe(F.col("__key"))).withColumn("part", part)
    nested = F.array_sort(F.collect_list(F.struct("__at", *fields)))
    return rows.groupBy(key, "part").agg(F.transform(nested, lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias(name))
