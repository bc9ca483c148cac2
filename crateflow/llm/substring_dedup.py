"""Substring dedup: repeated word windows of any position, removed but for their first place.

Every window of ``length`` words gets a Rabin-Karp hash (two, with different
bases: 56 bits of one travel, the other chooses the bucket). Tasks hash whole
texts in slices and send each bucket one packed row for a slice, with the
first place of each of its hashes; a hash that repeats within a slice is
settled there, so a passage that a third of the corpus holds reaches its
bucket once for each slice, not once for each document. A bucket counts its
hashes, and every place but the first goes back to its document as an
interval; a document's intervals are merged into maximal removal intervals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateflow.llm.common import (mix, raw_texts, shuffle_partitions, slices, utf8_buffers, window_hashes,
                                  word_hashes, word_spans)

_SECOND = np.uint64(0xA0761D6478BD642F)
_NULL = np.iinfo(np.int64).max  # a null id comes after all others

_SENT = "bucket int, hashes binary, places binary, owners binary"
_FOUND = "shard int, ranges binary"
_SPANS = "doc_id bigint, version bigint, starts binary, stops binary"


def _pack(values: np.ndarray, width: int) -> bytes:
    """Little-endian bytes of ``values``, plane by plane, compressed."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.T).tobytes())


def _unpack(blob: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8")


def _later(h: np.ndarray, doc: np.ndarray, version: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which places are not the first of their hash, by document and start; which repeat a place (equal rows)."""
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    same = np.zeros(len(h) + 1, dtype=bool)
    same[1:-1] = sorted_h[1:] == sorted_h[:-1]
    repeated = order[same[:-1] | same[1:]]
    later, twin = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=bool)
    if len(repeated):
        ranked = repeated[np.lexsort((start[repeated], version[repeated], doc[repeated], h[repeated]))]
        place = np.stack([h[ranked].view(np.int64), doc[ranked], version[ranked], start[ranked]])
        new_hash = np.ones(len(ranked), dtype=bool)
        new_hash[1:] = place[0, 1:] != place[0, :-1]
        first = np.maximum.accumulate(np.where(new_hash, np.arange(len(ranked)), 0))
        later[ranked] = (place != place[:, first]).any(axis=0)
        twin[ranked[1:]] = (place[:, 1:] == place[:, :-1]).all(axis=0)
    return later, twin


def _merged(doc: np.ndarray, version: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Ranges sorted by document and merged where they overlap or touch: rows doc, version, start, stop."""
    order = np.lexsort((start, version, doc))
    doc, version, start, stop = doc[order], version[order], start[order], stop[order]
    new_doc = np.ones(len(doc), dtype=bool)
    new_doc[1:] = (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])
    # the farthest stop so far in the same document: an offset for each document keeps them apart
    shift = np.cumsum(new_doc) * (int(stop.max(initial=0)) + 1)
    far = np.maximum.accumulate(stop + shift) - shift
    new = new_doc.copy()
    new[1:] |= start[1:] > far[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    return np.stack([doc[first], version[first], start[first], far[last]])


def _by_shard(ranges: np.ndarray, shards: int):
    """(shard, packed ranges) with each document's ranges in one shard."""
    shard = (mix(ranges[0].view(np.uint64) ^ ranges[1].view(np.uint64)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        mine = ranges[:, order[cuts[s]: cuts[s + 1]]]
        yield s, _pack(np.diff(mine, axis=1, prepend=0).ravel().view(np.uint64), 8)


def _unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob, 8).view(np.int64).reshape(4, -1), axis=1)


def _sender(length: int, buckets: int, slice_bytes: int, block: int = (1 << 20) - 64):
    """Arrow batches (doc_id, version, text) -> packed windows; bucket -1 - s holds ranges for shard s that the slice settled."""

    def send(batches):
        for part in slices(batches, "text", slice_bytes):
            doc = np.asarray(pa.compute.fill_null(part.column("doc_id"), _NULL), dtype=np.int64)
            version = np.asarray(part.column("version"), dtype=np.int64)
            data, offsets = utf8_buffers(part.column("text"))
            starts, stops, rows = word_spans(data, offsets)
            words = word_hashes(data, starts, stops)
            del starts, stops, data
            for a in range(0, max(0, len(words) - length + 1), block):
                here = words[a: a + block + length - 1]
                h, g = window_hashes(here, length), window_hashes(here, length, _SECOND)
                at = np.arange(a, a + len(h))
                owner = np.searchsorted(rows, at, side="right") - 1
                whole = at + length <= rows[owner + 1]
                at, owner, h, g = at[whole], owner[whole], h[whole] >> np.uint64(8), g[whole]
                first = rows[owner]
                start = at - first
                again, twin = _later(h ^ (mix(g) << np.uint64(56)), doc[owner], version[owner], start)
                if again.any():
                    ranges = _merged(doc[owner[again]], version[owner[again]], start[again], start[again] + length)
                    for shard, blob in _by_shard(ranges, buckets):
                        yield -1 - shard, blob, b"", b""
                keep = ~(again | twin)
                at, owner, h, to = at[keep], owner[keep], h[keep], (g[keep] % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                cuts = np.searchsorted(to[order], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cuts)):
                    mine = order[cuts[b]: cuts[b + 1]]
                    who, which = np.unique(owner[mine], return_inverse=True)
                    table = np.concatenate([np.diff(doc[who], prepend=0), version[who], rows[who]])
                    yield (int(b), _pack(h[mine], 7), _pack(np.diff(at[mine], prepend=0), 4),
                           _pack(table.astype(np.int64).view(np.uint64), 8))

    return _batched(send)


def _batched(rows_of, most: int = 4 << 20):
    """Rows gathered into record batches of a few MB."""
    schema = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("places", pa.binary()), ("owners", pa.binary())])

    def run(batches):
        held, size = [], 0
        for row in rows_of(batches):
            held.append(row)
            size += len(row[1]) + len(row[2]) + len(row[3])
            if size > most:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)

    return run


def _counter(length: int, shards: int):
    """The packed rows of one bucket -> ranges of every place that is not the first of its hash."""
    schema = pa.schema([("shard", pa.int32()), ("ranges", pa.binary())])

    def count(table: pa.Table) -> pa.Table:
        found, h, doc, version, start = [], [], [], [], []
        for bucket, hashes, places, owners in zip(*(table.column(c).to_pylist() for c in table.column_names)):
            if bucket < 0:
                found.append((-1 - bucket, hashes))
                continue
            h.append(_unpack(hashes, 7))
            at = np.cumsum(_unpack(places, 4).astype(np.int64))
            docs, versions, rows = np.split(_unpack(owners, 8).view(np.int64), 3)
            who = np.searchsorted(rows, at, side="right") - 1
            doc.append(np.cumsum(docs)[who])
            version.append(versions[who])
            start.append(at - rows[who])
        if h:
            h, doc, version, start = map(np.concatenate, (h, doc, version, start))
            later, _ = _later(h, doc, version, start)
            if later.any():
                found += _by_shard(_merged(doc[later], version[later], start[later], start[later] + length), shards)
        shard, blobs = zip(*found) if found else ((), ())
        return pa.table([pa.array(shard, pa.int32()), pa.array(blobs, pa.binary())], schema=schema)

    return count


def _gather(table: pa.Table) -> pa.Table:
    """All ranges of one shard -> one row for each document, with its maximal ranges."""
    schema = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("starts", pa.binary()), ("stops", pa.binary())])
    doc, version, start, stop = _merged(*np.concatenate([_unpacked(b) for b in table.column("ranges").to_pylist()], axis=1))
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])
    at = np.flatnonzero(new)
    cuts = list(zip(at.tolist(), [*at[1:].tolist(), len(doc)]))
    start, stop = start.astype("<u4"), stop.astype("<u4")
    return pa.table([pa.array(doc[at], mask=doc[at] == _NULL), pa.array(version[at]),
                     pa.array([start[a:b].tobytes() for a, b in cuts], pa.binary()),
                     pa.array([stop[a:b].tobytes() for a, b in cuts], pa.binary())], schema=schema)


def _remover(length: int):
    """Rows with their intervals -> counts, merged spans and the kept words."""
    schema = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()),
                        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])

    def remove(batches):
        for part in slices(batches, "text", 8 << 20):
            rows = []
            bounds_of = (part.column(c).to_pylist() for c in ("starts", "stops"))
            for raw, starts, stops in zip(raw_texts(part.column("text")), *bounds_of):
                words = (raw or b"").split()
                spans = []
                if starts:
                    bounds = list(zip(*(np.frombuffer(x, dtype="<u4").tolist() for x in (starts, stops))))
                    spans = [{"start": a, "stop": b} for a, b in bounds]
                    kept, at = [], 0
                    for a, b in [*bounds, (len(words), 0)]:
                        kept += words[at:a]
                        at = b
                else:
                    kept = words
                rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace"), spans))
            cols = [pa.array(c, t.type) for c, t in zip(zip(*rows), schema)]
            keep = [part.column(c) for c in ("doc_id",)]
            yield pa.RecordBatch.from_arrays(keep + cols, names=["doc_id", *schema.names])

    return remove


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20,
                   chars_per_bucket: int = 1 << 24, slice_bytes: int = 6 << 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans) for every row of ``docs``.

    A word goes if a window of ``length`` words that covers it also starts
    earlier: in a document with a smaller id, or earlier in the same one.
    ``spans`` are the maximal removed ranges of word positions, ``kept`` the
    words left, joined by one space. Words are runs without ASCII white space.

    Defined cases: a null text has no words; a null id comes after all other
    ids; rows that share an id are told apart by the CRC-32 of their texts
    (the smaller one counts as earlier), and equal rows are one document,
    reported for each row; fewer than ``length`` words: nothing goes; invalid UTF-8 is compared byte by byte and kept with replacement characters;
    a very long text is one row of one slice and is hashed in blocks; other
    columns are ignored; an empty table gives no rows.

    Buckets: one for ``chars_per_bucket`` characters of input, and at least
    as many as there are shuffle partitions, so what a task holds does not
    grow with the input. The two hashes give 56 bits and the bucket's.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = own.withColumn("version", F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(-1)).cast("bigint"))
    total = own.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-total // chars_per_bucket))
    sent = own.select("doc_id", "version", "text").mapInArrow(_sender(length, buckets, slice_bytes), _SENT)
    found = sent.groupBy("bucket").applyInArrow(_counter(length, buckets), _FOUND)
    spans = found.groupBy("shard").applyInArrow(_gather, _SPANS).alias("s")
    own = own.alias("d")
    joined = own.join(spans, F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.version") == F.col("s.version")),
                      "left").select("d.doc_id", "d.text", "s.starts", "s.stops")
    return joined.mapInArrow(_remover(length), "doc_id bigint, n_words bigint, n_removed bigint, kept string, "
                                               "spans array<struct<start:bigint,stop:bigint>>")
