"""WARC archives: writing pages as segmented records, reading archives back, reassembling segments.

A record whose block is longer than a segment is written as a first record
and continuation records that name its id, their number and, in the last
one, the total length. Reading groups the pieces by that origin id, orders
them by number, checks that none is missing and that the lengths add up,
and then undoes the chunked transfer framing of the HTTP body.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crateflow.llm.common import extended, slices

_END = b"\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = ("record_id string, warc_type string, origin_id string, segment bigint, total_length bigint, refers_to string, "
           "payload_digest string, page_id bigint, url string, block binary")


# ---- one record -----------------------------------------------------------------------

def record_id(page_id, digest: str) -> str:
    h = hashlib.sha1(f"{page_id}|{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}>"


def chunked(body: bytes, size: int) -> bytes:
    """Chunked transfer framing of a body."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (body[i: i + size] for i in range(0, len(body), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes | None:
    """The body inside chunked framing; extensions and trailers are skipped; None where the framing is broken."""
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(framed[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(out)
        if size < 0 or framed[end + 2 + size: end + 4 + size] != b"\r\n":
            return None
        out.append(framed[end + 2: end + 2 + size])
        at = end + 4 + size


def _head(fields) -> bytes:
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields if v is not None), "\r\n"]).encode()


def records_of(page_id, url, payload: bytes, digest: str, keeper, revisit: bool, segment_bytes: int, chunk_bytes: int,
               date: str):
    """The records of one page, in order, each without the two line ends that close it."""
    own = record_id(page_id, digest)
    url = None if url is None else re.sub(r"\s+", "%20", url)
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    common = [("WARC-Target-URI", url), ("WARC-Date", date)]
    if revisit:
        yield _head([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Profile", _PROFILE),
                     ("WARC-Refers-To", record_id(keeper, digest)), ("WARC-Payload-Digest", f"sha1:{b32}"),
                     ("Page-ID", page_id), ("Content-Type", "application/http; msgtype=response"),
                     ("Content-Length", len(_HTTP))]) + _HTTP
        return
    block = _HTTP + chunked(payload, chunk_bytes)
    parts = [block[i: i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    several = len(parts) > 1
    yield _head([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", f"sha1:{b32}"),
                 ("Page-ID", page_id), ("WARC-Segment-Number", 1 if several else None),
                 ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(parts[0]))]) + parts[0]
    for n, part in enumerate(parts[1:], 2):
        yield _head([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(f"{own} {n}", digest)), *common,
                     ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", n),
                     ("WARC-Segment-Total-Length", len(block) if n == len(parts) else None),
                     ("Content-Length", len(part))]) + part


def parse(data: bytes):
    """(header fields in lower case, block) of each record of an archive; damage is skipped up to the next record."""
    at = data.find(b"WARC/1.")
    while at >= 0:
        end = data.find(_END, at)
        if end < 0:
            return
        fields = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        try:
            size = int(fields["content-length"])
        except (KeyError, ValueError):
            size = -1
        if size >= 0 and end + 4 + size <= len(data):
            yield fields, data[end + 4: end + 4 + size]
            at = data.find(b"WARC/1.", end + 4 + size)
        else:  # no length, or cut off
            at = data.find(b"\r\nWARC/1.", at + 7)
            at = at + 2 if at >= 0 else -1


def unzipped(raw: bytes) -> bytes:
    """The bytes of a plain or gzip archive, of one member or many; a damaged or cut-off member ends it.

    Members are fed in pieces, so that what is left over at a member's end is
    a piece at most: the time is linear, however many members there are.
    """
    if raw[:2] != b"\x1f\x8b":
        return raw
    out, at, view = [], 0, memoryview(raw)
    while raw[at: at + 2] == b"\x1f\x8b":
        member, size = zlib.decompressobj(31), 1024
        while not member.eof and at < len(raw):
            piece = view[at: at + size]
            try:
                out.append(member.decompress(piece))
            except zlib.error:
                return b"".join(out)
            at += len(piece) - len(member.unused_data)
            size = min(2 * size, 1 << 18)
    return b"".join(out)


# ---- writing ------------------------------------------------------------------------------

def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_revisit_bytes: int = 1000, segment_bytes: int = 8192, chunk_bytes: int = 4096,
                   records_per_file: int = 4000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record (and its continuations) for each page to gzip archives under ``path``.

    Of pages with equal payloads of at least ``min_revisit_bytes``, that
    with the largest id is the response and the others are revisits of it.
    A file holds at most ``records_per_file`` records of ``segment_bytes``
    of block, so that its reader's memory is bounded.
    """
    own = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                       F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("digest", F.sha1("payload"))
    repeated = (own.where(F.octet_length("payload") >= min_revisit_bytes).groupBy(F.col("digest").alias("__digest"))
                .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    # short payloads have no digest in the table, so they stay responses
    own = own.join(repeated, F.col("digest") == F.col("__digest"), "left").drop("__digest")
    own = own.withColumn("revisit", F.coalesce(F.col("page_id") != F.col("keeper"), F.col("keeper").isNotNull()))

    def run(batches):
        for part in slices(batches, "payload", 8 << 20):
            out = []
            for row in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "keeper", "revisit"))):
                out.extend(records_of(*row, segment_bytes, chunk_bytes, date))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    (own.mapInArrow(run, "record binary").select(F.col("record").cast("string"))
     .write.option("compression", "gzip").option("lineSep", _END.decode()).option("maxRecordsPerFile", records_per_file)
     .text(path))


# ---- reading ------------------------------------------------------------------------------

def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under ``path`` (plain or gzip), as it stands in the files."""

    def run(batches):
        names = [f.split()[0] for f in _RECORD.split(", ")]
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(),
                 pa.string(), pa.binary()]
        number = lambda x: int(x) if x is not None and re.fullmatch(r"-?\d{1,18}", x) else None

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for files in batches:
            for i in range(files.num_rows):
                rows, size = [], 0
                for f, block in parse(unzipped(files.column("content")[i].as_py())):
                    rows.append((f.get("warc-record-id"), f.get("warc-type"), f.get("warc-segment-origin-id"),
                                 number(f.get("warc-segment-number")), number(f.get("warc-segment-total-length")),
                                 f.get("warc-refers-to"), f.get("warc-payload-digest"), number(f.get("page-id")),
                                 f.get("warc-target-uri"), block))
                    size += len(block)
                    if size > 4 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """One row per logical record: segments grouped by origin, ordered, checked; ``complete`` says if all is there.

    A record without a segment number is whole. Of a segmented one, numbers
    1 to the largest must all be there, the last must give the total length,
    and the lengths must add up to it; otherwise ``complete`` is false and the block null.
    A record that is stored twice is one record with ``copies`` 2.
    """
    kept = ["record_id", "warc_type", "refers_to", "payload_digest", "page_id", "url"]
    whole = records.where("segment is null and warc_type <> 'continuation'").select(
        *kept, "block", F.lit(True).alias("complete"), F.lit(1).cast("bigint").alias("copies"))
    pieces = records.where("segment is not null or warc_type = 'continuation'")
    pieces = (pieces.withColumn("origin", F.coalesce("origin_id", "record_id")).groupBy("origin", "segment")
              .agg(F.count(F.lit(1)).alias("n"), F.max("total_length").alias("total_length"), F.min("block").alias("block"),
                   *[F.min(c).alias(c) for c in kept]))
    first = lambda c: F.min(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    groups = pieces.groupBy("origin").agg(
        *[first(c) for c in kept], F.min(F.when(F.col("segment") == 1, F.col("n"))).alias("copies"),
        F.max("segment").alias("last"), F.count("segment").alias("have"), F.min("segment").alias("least"),
        F.sum(F.octet_length("block")).alias("bytes"), F.max("total_length").alias("total"),
        F.sort_array(F.collect_list(F.struct("segment", F.col("block").cast("string").alias("block")))).alias("parts"))
    good = (F.col("least") == 1) & (F.col("have") == F.col("last")) & (F.col("bytes") == F.col("total"))
    groups = groups.withColumn("complete", F.coalesce(good, F.lit(False)))
    joined = F.array_join(F.transform("parts", lambda p: p["block"]), "").cast("binary")
    groups = groups.withColumn("record_id", F.coalesce("record_id", "origin")).select(
        *kept, F.when(F.col("complete"), joined).alias("block"), "complete", F.coalesce("copies", F.lit(1)).alias("copies"))
    return whole.unionByName(groups)


def payloads(logical: DataFrame) -> DataFrame:
    """Logical records with their payload decoded from the HTTP message, its size, SHA-1, and whether the digest agrees.

    Revisits and incomplete records have a null payload; so has a response
    with broken chunked framing. ``payload_sha1`` is that of the payload, or
    the recorded one where there is no payload.
    """

    def recorded(digest):
        try:
            return base64.b32decode(digest.partition(":")[2]).hex() if digest and digest.startswith("sha1:") else None
        except ValueError:
            return None

    names = [c for c in logical.columns if c != "block"]

    def run(batches):
        for part in slices(batches, "block", 8 << 20):
            rows = []
            for kind, digest, block in zip(*(part.column(c).to_pylist() for c in ("warc_type", "payload_digest", "block"))):
                said, body = recorded(digest), None
                if kind == "response" and block is not None:
                    head, _, body = block.partition(_END)
                    if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r", b"")):
                        body = unchunked(body)
                own = said if body is None else hashlib.sha1(body).hexdigest()
                rows.append((body, None if body is None else len(body), own, None if body is None or said is None else own == said))
            types = [pa.binary(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(c, t) for c, t in zip(zip(*rows), types))],
                                             names=[*names, "payload", "payload_bytes", "payload_sha1", "digest_agrees"])

    schema = extended(logical, names, "payload binary, payload_bytes bigint, payload_sha1 string, digest_agrees boolean")
    return logical.mapInArrow(run, schema)
