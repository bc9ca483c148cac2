"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet on shared seeds: hashes of ``min_match``
consecutive words. The benchmark goes out in blocks of bounded size, each a
sorted seed table with its postings, and every document is read whole against each block. A pair whose
shared seeds could cover enough of the item is tiled: its seed matches are
joined along diagonals into the longest common runs by running Karp-Rabin
hashes, and the longest unmarked run is marked again and again until none of
``min_match`` words is left. The marked share of the item decides, so a
passage whose parts were reordered is found like the passage itself.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateflow.llm.common import slices, utf8_buffers, window_hashes, word_hashes, word_spans, written

#: ASCII other than letters and digits becomes a space.
_FOLD = np.frombuffer(bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)), dtype=np.uint8)
_FILTER_BITS = 24
_HIT = "doc_id bigint, version bigint, item_id bigint, item_words int, matched int, coverage double, copies int"


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, where each row's words begin) of lower-cased texts."""
    try:
        column = pc.utf8_lower(column)
    except pa.ArrowInvalid:  # not UTF-8
        raw = column.cast(pa.binary()).to_pylist()
        column = pa.array([t if t is None else t.decode("utf-8", "replace").lower() for t in raw], pa.string())
    data, offsets = utf8_buffers(column)
    data = _FOLD[data]
    starts, stops, rows = word_spans(data, offsets)
    return word_hashes(data, starts, stops), rows


def _seeds(words: np.ndarray, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start in words) of all windows of ``length`` words that stay in one row."""
    h = window_hashes(words, length)
    at = np.arange(len(h))
    row = np.searchsorted(rows, at, side="right") - 1
    inside = at + length <= rows[row + 1]
    return h[inside], row[inside], at[inside]


def tile(pairs: np.ndarray, lengths: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of maximal common runs ``pairs`` (place in text, place in item), ``lengths`` words long.

    The longest unmarked run goes first; of equal ones that earliest in the
    item, then in the text. A run that meets marked words is cut into its
    unmarked parts, and those of ``min_match`` words or more stay. Returns
    the tiles as (place in text, place in item, length).
    """
    heap = [(-n, j, i) for (i, j), n in zip(pairs.tolist(), lengths.tolist())]
    heapq.heapify(heap)
    in_text, in_item, tiles = set(), set(), []
    while heap:
        n, j, i = heapq.heappop(heap)
        free = [i + k not in in_text and j + k not in in_item for k in range(-n)]
        if all(free):
            in_text.update(range(i, i - n))
            in_item.update(range(j, j - n))
            tiles.append((i, j, -n))
            continue
        start = None
        for k, ok in enumerate([*free, False]):
            if ok and start is None:
                start = k
            elif not ok and start is not None:
                if k - start >= min_match:
                    heapq.heappush(heap, (start - k, j + start, i + start))
                start = None
    return tiles


def _runs(i: np.ndarray, j: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Seed matches (i, j) joined along diagonals: starts and lengths of maximal common runs."""
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    new = np.ones(len(i), dtype=bool)
    new[1:] = (np.diff(i - j) != 0) | (np.diff(i) != 1)
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(i))) + length - 1
    return np.stack([i[first], j[first]], axis=1), sizes


class Items:
    """One block of the benchmark: seeds of each length in use, sorted, with their places."""

    def __init__(self, ids: list, texts: list, copies: list, min_match: int):
        self.ids, self.copies, self.min_match = ids, copies, min_match
        words, rows = _words(pa.array(texts, pa.string()))
        self.size = np.diff(rows)
        self.tables = []
        # items of fewer words than a seed are their own seed
        for length in sorted({min(min_match, n) for n in self.size.tolist() if n}):
            h, item, at = _seeds(words, rows, length)
            own = np.minimum(self.size[item], min_match) == length
            h, item, at = h[own], item[own], at[own] - rows[item[own]]
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
            bits[h >> np.uint64(64 - _FILTER_BITS)] = True
            self.tables.append((length, h[order], item[order], at[order], bits))


def _finder(items: Items, threshold: float, block: int = 1 << 18):
    """Arrow batches of documents -> pairs over the threshold."""

    def pairs_of(words, rows, a, b, length, h, item, at, bits):
        """Matches of the seeds of rows a..b: (row, item, place in text, place in item)."""
        lo, hi = int(rows[a]), int(rows[b])
        if lo == hi:  # no word in any of them
            return
        found = []
        for start in range(lo, hi, block):
            here = window_hashes(words[start: min(hi, start + block + length - 1)], length)
            maybe = np.flatnonzero(bits[here >> np.uint64(64 - _FILTER_BITS)])
            maybe = maybe[h[np.minimum(np.searchsorted(h, here[maybe]), len(h) - 1)] == here[maybe]]
            place = maybe + start
            row = np.searchsorted(rows, place, side="right") - 1
            inside = place + length <= rows[row + 1]
            found.append((here[maybe][inside], row[inside], place[inside]))
        key, row, place = map(np.concatenate, zip(*found))
        # which pairs could be covered enough: by each text's different seeds
        once = np.unique(np.stack([row.astype(np.uint64), key]), axis=1) if len(key) else np.zeros((2, 0), np.uint64)
        left, right = np.searchsorted(h, once[1]), np.searchsorted(h, once[1], side="right")
        n = right - left
        post = np.repeat(left - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        who, what, where = np.repeat(once[0].astype(np.int64), n), item[post], at[post]
        order = np.lexsort((where, what, who))
        who, what, where = who[order], what[order], where[order]
        if not len(who):
            return
        new = np.ones(len(who), dtype=bool)
        new[1:] = (np.diff(who) != 0) | (np.diff(what) != 0)
        first = np.flatnonzero(new)
        reach = np.full(len(who), length)
        reach[:-1] = np.where(new[1:], length, np.minimum(length, np.diff(where)))
        bound = np.add.reduceat(reach, first)
        for k in np.flatnonzero(bound >= threshold * items.size[what[first]]):
            s, e = first[k], first[k + 1] if k + 1 < len(first) else len(who)
            places, keys = where[s:e], h[post[order[s:e]]]
            by = np.argsort(keys, kind="stable")
            own = slice(np.searchsorted(row, who[s]), np.searchsorted(row, who[s], side="right"))
            spots, at_key = place[own], key[own]
            l, r = np.searchsorted(keys[by], at_key), np.searchsorted(keys[by], at_key, side="right")
            m = r - l
            pick = np.repeat(l - np.cumsum(m) + m, m) + np.arange(int(m.sum()))
            yield int(who[s]), int(what[s]), np.repeat(spots, m), places[by][pick]

    def run(batches):
        for part in slices(batches, "text", 4 << 20):
            words, rows = _words(part.column("text"))
            doc, version = part.column("doc_id").to_pylist(), part.column("version").to_pylist()
            out = []
            for length, *table in items.tables:
                for row, item, i, j in pairs_of(words, rows, 0, len(doc), length, *table):
                    starts, sizes = _runs(i, j, length)
                    marked = sum(n for _, _, n in tile(starts, sizes, length))
                    size = int(items.size[item])
                    if marked >= threshold * size:
                        out.append((doc[row], version[row], items.ids[item], size, marked, marked / size, items.copies[item]))
            names = ["doc_id", "version", "item_id", "item_words", "matched", "coverage", "copies"]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32()]
            columns = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return run


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.coalesce(F.crc32(text.cast("binary")), F.lit(-1)).cast("bigint").alias("version"), text.alias("text"))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_id_col: str = "item_id", item_text_col: str = "text", min_match: int = 5,
                       threshold: float = 0.7, block_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, version, item_id, item_words, matched, coverage) of each document and item it holds.

    ``coverage`` is the share of the item's words in tiles of at least
    ``min_match`` words (of all words for a shorter item); pairs of at least
    ``threshold`` are returned. Words are runs without ASCII white space and
    punctuation, in lower case. The benchmark is sent out in blocks of about
    ``block_bytes`` of text, one pass over the documents for each; a single
    item larger than that is a block of its own.

    Defined cases: a null or wordless text holds nothing, a null or wordless
    item is held by nothing; null ids stay null; repeated rows of documents give
    repeated pairs, repeated items are each reported; ``version`` is the
    CRC-32 of the text and tells rows with one id apart; other columns are
    ignored; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    own = _prepared(docs, id_col, text_col)
    items = benchmark.select(F.col(item_id_col).cast("bigint").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    # equal rows of the benchmark are tiled once and reported as often as they are there
    items = items.where("text is not null").groupBy("item_id", "text").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    items = written(items.withColumn("bytes", F.octet_length("text")), "benchmark-items")
    total, largest = items.agg(F.sum("bytes"), F.max("bytes")).first()
    blocks = max(1, -(-(total or 0) // block_bytes))
    by = F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks))
    out = None
    for b in range(blocks):
        rows = items.where(by == b).select("item_id", "text", "copies").collect()  # about block_bytes
        sent = spark.sparkContext.broadcast(tuple([r[c] for r in rows] for c in ("item_id", "text", "copies")))
        part = own.mapInArrow(_task(sent, min_match, threshold), _HIT)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("copies", F.explode(F.array_repeat(F.lit(True), F.col("copies")))).drop("copies")


def _task(sent, min_match: int, threshold: float):
    def run(batches):
        return _finder(Items(*sent.value, min_match), threshold)(batches)

    return run


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        **options) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item (see ``contaminated_pairs``)."""
    pairs = contaminated_pairs(docs, benchmark, id_col, text_col, **options)
    # stored, so that Spark knows its size when it plans the join
    bad = written(pairs.select(F.col("doc_id").alias("__id"), F.col("version").alias("__version")).distinct(), "contaminated")
    version = F.coalesce(F.crc32(F.col(text_col).cast("string").cast("binary")), F.lit(-1))
    return docs.join(bad, F.col(id_col).cast("bigint").eqNullSafe(F.col("__id")) & (version == F.col("__version")), "left_anti")
