"""SimHash near-dedup: 64-bit fingerprints linked within a Hamming radius through BK-trees.

A fingerprint holds, bit by bit, the majority of the XXH64 values of a
text's word shingles. Equal fingerprints are one class from the start, so a
group of copies is one key however large it is. Classes meet in shards: the
64 bits are cut into eight bytes, and two fingerprints within radius r agree
on 8 - r bytes of some choice, so each class joins one shard for each choice
of bytes left out (28 for r = 2). A shard holds at most 256**r different
fingerprints by construction. In each shard a BK-tree is built (children
keyed by the integer Hamming distance to the parent) and searched for every
member, following only edges whose key is within r of the query's distance;
the links found leave the shard as a spanning forest, never as all pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateflow.llm.common import slices, written
from crateflow.operators.components import connected


def fingerprint(text: bytes | None, words: int = 3, block: int = 1 << 14) -> int:
    """The fingerprint of one text, as an unsigned integer; zero without a word."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    size = min(words, len(tokens))
    stops = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1)
    starts = np.concatenate([[0], stops[:-1]])
    n = len(tokens) - size + 1
    a, b = starts[:n].tolist(), (stops[size - 1:] - 1).tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, block):
        h = b"".join([digest(joined[i:j], 42) for i, j in zip(a[at: at + block], b[at: at + block])])
        ones += np.unpackbits(np.frombuffer(h, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, version, bits): fingerprint of each row as a signed 64-bit integer; version is the text's CRC-32."""

    def run(batches):
        for part in slices(batches, "text", 4 << 20):
            raw = [fingerprint(t, words) for t in part.column("text").to_pylist()]
            bits = np.array(raw, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("version"), pa.array(bits)],
                                             names=["doc_id", "version", "bits"])

    text = F.col(text_col).cast("string").cast("binary")
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                      F.coalesce(F.crc32(text), F.lit(-1)).cast("bigint").alias("version"), text.alias("text"))
    return own.mapInArrow(run, "doc_id bigint, version bigint, bits bigint")


def tree_forest(values: np.ndarray, radius: int) -> np.ndarray:
    """Links of a shard within ``radius``, as rows (member, least member of its part), by one BK-tree.

    The tree is built and searched together, a node at a time for all
    queries that reach it: a child with key d is entered by the queries whose
    distance to the parent is within ``radius`` of d.
    """
    values = np.unique(values.astype(np.uint64))
    label = np.arange(len(values))
    every = np.arange(len(values))
    stack = [(every, every)]
    while stack:
        members, queries = stack.pop()
        root, rest = members[0], members[1:]
        far = np.bitwise_count(values[queries] ^ values[root])
        near = queries[far <= radius]
        parts = np.unique(label[np.append(near, root)])
        if len(parts) > 1:
            label[np.isin(label, parts)] = parts[0]
        if len(rest):
            key = np.bitwise_count(values[rest] ^ values[root]).astype(np.int16)
            far = far.astype(np.int16)
            for d in np.unique(key):
                entering = queries[np.abs(far - d) <= radius]
                if len(entering):
                    stack.append((rest[key == d], entering))
    linked = np.flatnonzero(label != every)
    return np.stack([values[linked], values[label[linked]]], axis=1)


def _searcher(radius: int):
    def run(batches):
        for batch in batches:
            found = [tree_forest(np.array(shard, dtype=np.int64).view(np.uint64), radius)
                     for shard in batch.column("shard").to_pylist()]
            found = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, i].view(np.int64)) for i in (0, 1)], names=["u", "v"])

    return run


def links(classes: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (u, v) that join all ``bits`` of ``classes`` (distinct) within ``radius`` into the right components."""
    if not 0 < radius < 8:
        raise ValueError("radius is 1 to 7")
    masks = []
    for free in itertools.combinations(range(8), radius):
        mask = (1 << 64) - 1 - sum(0xFF << 8 * b for b in free)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keys = F.posexplode(F.array(*[F.col("bits").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "agreed")
    shards = (classes.select("bits", keys).groupBy("choice", "agreed").agg(F.collect_list("bits").alias("shard"))
              .where(F.size("shard") > 1).select("shard"))
    return shards.mapInArrow(_searcher(radius), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                    radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id, version, component) for every row of ``docs``.

    ``fingerprint`` is 16 lower-case hex digits. Rows whose fingerprints
    differ in ``radius`` bits or fewer are linked; ``component_id`` is the
    smallest doc_id that links reach. ``component`` names the component
    (its least fingerprint as a signed number), ``version`` is the CRC-32 of
    the text (-1 for null) and tells rows with one id apart.

    Defined cases: a null, empty or blank text has fingerprint zero, which
    links like any other; fewer than ``words`` words make one shingle; a
    null id never is the smallest, and a component of null ids alone has
    component_id null; repeated rows are all reported; other columns are
    ignored; an empty table gives no rows.
    """
    rows = written(fingerprints(docs, id_col, text_col, words), "simhash")
    classes = rows.groupBy("bits").agg(F.min("doc_id").alias("doc_id"))
    classes = written(classes, "simhash-classes")
    nodes = connected(links(classes.select("bits"), radius)).withColumnRenamed("node", "bits")
    members = classes.join(nodes, "bits", "left").withColumn("component", F.coalesce("component", "bits"))
    members = written(members, "simhash-members")
    least = members.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = members.join(least, "component").select("bits", "component", "component_id")
    return rows.join(named, "bits").select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id", "version", "component")
