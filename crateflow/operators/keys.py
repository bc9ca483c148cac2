"""Small key sets reused by several branches of one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from crateflow.session import cut_lineage


def pin_keys(df: DataFrame, col: str) -> DataFrame:
    """Evaluate a key set once and reuse it.

    A listing (top-k, a page) feeds several joins; left lazy, its whole plan
    would run once per branch. The keys are written to the shared folder, so
    Spark knows their size when it chooses the joins.
    """
    return cut_lineage(df.select(col).distinct())


def pin_rows(df: DataFrame) -> DataFrame:
    """Evaluate a listing once (a top-k page) and reuse its rows."""
    return cut_lineage(df)
