"""Line dedup by site-relative frequency: lines that too large a share of a host's pages carry are dropped.

Pages are grouped by host. For each line the number of its host's pages that
contain it is divided by the host's page total, and a line beyond the
boilerplate ratio is dropped wherever the host has it. Only line hashes and
counts are shuffled (with map-side combine, so a hot host is spread over its
lines), and what comes back is one short list for each host: a page has some
average number of lines, so no more than that number divided by the ratio
can be beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateflow.llm.common import written


def _lines(text):
    return F.split(text, "\n", -1)


def _bare(line):
    """A line without blanks, tabs and carriage returns at its ends."""
    return F.trim(line, F.lit(" \t\r"))


def _key(line):
    return F.xxhash64(_bare(line))


def _blank(line):
    return _bare(line) == ""


def boilerplate_lines(pages: DataFrame, host_col: str, text_col: str, max_ratio: float, min_pages: int) -> DataFrame:
    """(host, lines): hashes of the lines that more than ``max_ratio`` of a host's pages contain."""
    text = F.col(text_col).cast("string")
    own = pages.where(F.col(host_col).isNotNull() & text.isNotNull()).select(
        F.col(host_col).cast("string").alias("host"),
        F.array_distinct(F.transform(F.filter(_lines(text), lambda x: ~_blank(x)), _key)).alias("lines"))
    totals = (pages.where(F.col(host_col).isNotNull()).groupBy(F.col(host_col).cast("string").alias("host"))
              .agg(F.count(F.lit(1)).alias("total")))
    counts = (own.select("host", F.explode("lines").alias("line")).groupBy("host", "line")
              .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages))
    over = counts.join(totals, "host").where(F.col("n") / F.col("total") > max_ratio)
    return over.groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = 0.1,
                     min_pages: int = 3, kept_col: str = "kept_text", lines_col: str = "n_lines",
                     dropped_col: str = "n_dropped") -> DataFrame:
    """``pages`` with the text left after dropping boilerplate lines, its lines before, and how many went.

    A line is boilerplate on a host if at least ``min_pages`` of the host's
    pages contain it and these are more than ``max_ratio`` of all its pages.
    The ratio decides at every size of host; ``min_pages`` only tells a repeat
    from a page's own line, which on a small host is beyond any ratio. Lines are compared without blanks, tabs and
    carriage returns at their ends; blank lines are neither counted nor dropped.

    Defined cases: a page without a host keeps every line; a null text stays
    null, has no lines, and counts in its host's page total; a line that a page has
    twice counts once for that page; repeated rows are pages of their own;
    the new columns replace columns of the same names, others pass through;
    an empty table gives no rows.
    """
    found = written(boilerplate_lines(pages, host_col, text_col, max_ratio, min_pages), "boilerplate")
    found = found.select(F.col("host").alias("__own_host"), F.col("lines").alias("__own_gone"))
    new = (kept_col, lines_col, dropped_col)
    kept = [c for c in pages.columns if c not in new]
    joined = pages.select(*kept, F.col(host_col).cast("string").alias("__own_at"), F.col(text_col).cast("string").alias("__own_text")
                          ).join(found, F.col("__own_at") == F.col("__own_host"), "left")
    gone = lambda x: F.coalesce(F.array_contains("__own_gone", _key(x)), F.lit(False)) & ~_blank(x)
    left = F.array_join(F.filter(_lines(F.col("__own_text")), lambda x: ~gone(x)), "\n")
    count = lambda a: F.greatest(F.size(a), F.lit(0)).cast("bigint")
    return joined.select(
        *kept, F.when(F.col("__own_gone").isNull(), F.col("__own_text")).otherwise(left).alias(kept_col),
        count(F.filter(_lines(F.coalesce("__own_text", F.lit(""))), lambda x: ~_blank(x))).alias(lines_col),
        F.when(F.col("__own_gone").isNull(), F.lit(0).cast("bigint"))
        .otherwise(count(F.filter(_lines(F.coalesce("__own_text", F.lit(""))), gone))).alias(dropped_col))
