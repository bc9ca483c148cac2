"""Substring search over a stored trigram index.

The index has a row (gram, id) for every distinct three characters of a
lower-cased text. A pattern's candidates are the ids that hold all its
grams: the index is kept sorted by gram, so the gram filter reaches the row
groups of the scan, and ids are counted with map-side combine. Only
candidates are read from the table, and every one is verified by the same
``ILIKE`` as a full scan, so the answers are equal. Patterns under three
characters, or with wildcards, scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateflow.functions.text import contains_ci
from crateflow.operators import catalog as C
from crateflow.operators.ordering import with_position

GRAM = 3


def trigrams(text: str) -> list[str]:
    """The distinct grams of a pattern as the index holds them."""
    text = text.lower()
    return sorted({text[i: i + GRAM] for i in range(len(text) - GRAM + 1)})


def trigram_index(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(gram, id) of every distinct gram of a text; texts under three characters have none. Sorted by gram within ranges."""
    text = F.lower(F.col(text_col))
    starts = F.sequence(F.lit(1), F.length("__t") - (GRAM - 1))
    rows = df.select(F.col(id_col).alias("id"), text.alias("__t")).where(F.length("__t") >= GRAM)
    grams = rows.select("id", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("__t"), i, F.lit(GRAM))))).alias("gram"))
    return grams.select("gram", "id").distinct().repartitionByRange("gram", "id").sortWithinPartitions("gram", "id")


def candidates(index: DataFrame, text: str) -> DataFrame | None:
    """(id) of texts that hold every gram of ``text``; None where the index cannot tell."""
    grams = trigrams(text)
    if not grams:
        return None
    hits = index.where(F.col("gram").isin(grams))
    return hits.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select("id")


def _matching(df: DataFrame, index: DataFrame, id_col: str, text_col: str, text: str) -> DataFrame:
    ids = candidates(index, text)
    some = df if ids is None else df.join(ids.withColumnRenamed("id", id_col), id_col, "left_semi")
    return some.filter(contains_ci(text_col, text))


def artist_index(m) -> DataFrame:
    """The index of artist names, stored once for each dataset."""
    return _stored(m, "trigrams_artist", lambda: trigram_index(m.t("artist"), "id_artist", "name_artist"))


def title_index(m) -> DataFrame:
    """The index of the collection's titles by release, stored once for each dataset."""
    return _stored(m, "trigrams_title", lambda: trigram_index(m.t("collection_items"), "id_release", "title"))


def _stored(m, name: str, build) -> DataFrame:
    return m.stored(name, build) if hasattr(m, "stored") else build()


def artists_search(m, text: str) -> DataFrame:
    """Q7 over the index: the rows of ``catalog.artists_search``."""
    ids = _matching(m.t("artist"), artist_index(m), "id_artist", "name_artist", text).select("id_artist")
    return with_position(C.artist_catalog(m, fmt=None, artist_ids=ids), C._artist_order())


def collection_search(m, text: str) -> DataFrame:
    """Q18 over the index: the rows of ``catalog.collection_search``."""
    return with_position(_matching(C.collection_base(m), title_index(m), "id_release", "title", text), C._item_order_b())


def artists_search_or_all(m, text: str) -> DataFrame:
    """Q27 over the index."""
    return C.artists_all(m) if not text else artists_search(m, text)
