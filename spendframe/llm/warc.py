"""Web archives written and read as a table of record chunks.

A record too large for one chunk becomes a first segment and continuation records (WARC segmentation), each one row of
(record key, chunk number, bytes). Writing and reading go through Spark's text files with the record boundary as
line separator, so archives live wherever Spark can write. Digests are carried from chunk to
chunk; no step joins the chunks of a record.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import encoded, new_path

VERSION = b"WARC/1.1"
#: What stands between two records: the end of a block, and the first line of the next header.
BOUNDARY = b"\r\n\r\n" + VERSION + b"\r\n"
CHUNK, RECORDS_PER_FILE = 1 << 20, 50_000
REVISIT_BYTES = 1000
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_INSIDE = re.compile(rb"(?:\A|\r\n\r\n)WARC/1\.1")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")

RECORDS = "key string, chunk int, total int, page_id string, type string, refers_to string, digest string, length long, size long, data binary"


def chunks(payload: bytes, size: int = CHUNK) -> Iterator[memoryview]:
    """The payload in parts of at most `size` bytes, cut so that none holds a record boundary; one empty part if empty."""
    view, start = memoryview(payload), 0
    while True:
        end = min(start + size, len(view))
        found = _INSIDE.search(view[start:end])
        if found:
            end = start + found.end() - 6  # between the first and the last letters of the version
        elif end < len(view) and (tail := _INSIDE.search(view[max(start, end - 12):end + 12])):
            end = max(start, end - 12) + tail.end() - 6
        yield view[start:end]
        start = end
        if start >= len(view):
            return


def roles(pages: DataFrame, payload: str = "html", page_id: str = "page_id", least: int = REVISIT_BYTES) -> DataFrame:
    """`pages` with `refers_to`: among equal payloads of at least `least` bytes all but the largest id refer to it.

    Payloads are grouped by digest and length; sums are made before the shuffle, and only shared payloads are joined.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    keyed = pages.withColumn("_digest", F.sha1(body)).withColumn("_size", F.octet_length(body))
    shared = keyed.filter(F.col("_size") >= least).groupBy("_digest", "_size").agg(
        F.max(page_id).alias("_largest"), F.count("*").alias("_n")).filter(F.col("_n") > 1).drop("_n")
    return keyed.join(shared, ["_digest", "_size"], "left").withColumn(
        "refers_to", F.when(~F.col("_largest").eqNullSafe(F.col(page_id)), F.col("_largest"))).drop("_digest", "_size", "_largest")


def _write(size: int, date: str):
    def header(fields: dict[str, object], length: int) -> bytes:
        lines = [f"{k}: {v}" for k, v in fields.items() if v is not None] + [f"Content-Length: {length}"]
        return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n"

    def records(page, url, html, refers) -> Iterator[bytes]:
        payload, key = encoded(html), uuid4().hex
        name = f"<urn:page:{'' if page is None else page}>"
        base = {"WARC-Date": date, "X-Record-Key": key, "X-Page-ID": page}
        first = {"WARC-Record-ID": name, "WARC-Target-URI": _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or ""),
                 "Content-Type": "application/http; msgtype=response"}
        if refers is not None:
            digest = hashlib.sha1()
            for part in chunks(payload, size):
                digest.update(part)
            yield header({"WARC-Type": "revisit", **base, **first, "WARC-Refers-To": f"<urn:page:{refers}>", "X-Payload-Length": len(payload),
                          "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                          "WARC-Payload-Digest": f"sha1:{digest.hexdigest()}"}, len(_HEAD)) + _HEAD + b"\r\n"
            return
        digest, number, sent, waiting = hashlib.sha1(), 0, 0, None
        for part in chunks(payload, size):
            if waiting is not None:
                yield waiting
            digest.update(part)
            number, sent = number + 1, sent + len(part)
            last = sent == len(payload)
            block = (_HEAD if number == 1 else b"") + bytes(part)
            fields = {"WARC-Type": "response", **base, **first} if number == 1 else {
                "WARC-Type": "continuation", **base, "WARC-Record-ID": f"<urn:page:{page}:{key}:{number}>", "WARC-Segment-Origin-ID": name}
            if number > 1 or not last:
                fields["WARC-Segment-Number"] = number
            if last:
                fields["WARC-Payload-Digest"] = f"sha1:{digest.hexdigest()}"
                fields["WARC-Segment-Total-Length"] = sent + len(_HEAD) if number > 1 else None
            waiting = header(fields, len(block)) + block + b"\r\n"
        yield waiting

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for row in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                for record in records(*row):
                    out.append(record)
                    held += len(record)
                    if held >= 4 * size:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return run


def write(pages: DataFrame, path: str, payload: str = "html", page_id: str = "page_id", url: str = "url", size: int = CHUNK,
          least: int = REVISIT_BYTES) -> None:
    """A record per row under `path`, in gzip files of a bounded number of records.

    A null payload is empty. A null id is written as none. Repeated rows are records of their own.
    """
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    slim = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(payload).cast("string").alias("html"))
    rows = roles(slim, least=least).select(F.col("page_id").cast("string"), "url", "html", F.col("refers_to").cast("string"))
    (rows.mapInArrow(_write(size, date), "value binary").select(F.col("value").cast("string"))
     .write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 4, pa.int64(), pa.int64(), pa.binary()]
    names = [part.split()[0] for part in RECORDS.split(", ")]
    for batch in batches:
        rows = []
        for value in batch.column(0).to_pylist():
            head, _, rest = value.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n") if ": " in line)
            if "WARC-Type" not in fields:
                continue
            block = memoryview(rest)[:int(fields["Content-Length"])]
            kind, chunk = fields["WARC-Type"], int(fields.get("WARC-Segment-Number", 1))
            if kind != "continuation":
                block = block[rest.find(b"\r\n\r\n") + 4:]
            refers = fields.get("WARC-Refers-To", "")[len("<urn:page:"):-1] or None
            digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
            whole = chunk == 1 and digest is not None
            size = int(fields.get("X-Payload-Length", len(block)))
            if whole and kind == "response" and hashlib.sha1(block).hexdigest() != digest:
                digest = None
            rows.append((fields["X-Record-Key"], chunk, chunk if digest else None, fields.get("X-Page-ID"), kind, refers, digest, size,
                         len(block), None if whole else bytes(block)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per record from its chunks in order; the digest and the length are all that is kept between chunks."""
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    state = {"key": None}

    def finished() -> list[tuple]:
        if state["key"] is None:
            return []
        found = state["digest"].hexdigest() if state["chunks"] else state["claimed"]
        intact = found is not None and found == state["claimed"] and state["ok"]
        return [(state["page"], state["length"], found, state["type"], state["refers"], intact)]

    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if r["key"] != state["key"]:
                rows += finished()
                state = {"key": r["key"], "page": r["page_id"], "type": r["type"], "refers": r["refers_to"], "digest": hashlib.sha1(),
                         "length": 0, "chunks": 0, "claimed": None, "ok": r["chunk"] == 1, "next": 1}
            state["ok"] &= r["chunk"] == state["next"]
            state["next"] += 1
            state["claimed"] = r["digest"] or state["claimed"]
            if r["data"] is not None:
                state["digest"].update(r["data"])
                state["chunks"] += 1
            state["length"] += r["length"]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    if rows := finished():
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def record_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The archives under `path` as chunk rows. The bytes of a record in one chunk are checked here and not passed on."""
    text = spark.read.option("lineSep", BOUNDARY.decode()).text(path).select(F.col("value").cast("binary"))
    return text.mapInArrow(_parse, RECORDS)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, intact) of every record under `path`.

    Chunks are dealt out by record and sorted within the task's disk-backed sort, so a record of any size passes
    chunk by chunk. `intact` is false where the payload doesn't have the digest in its header or a chunk is missing.
    """
    ordered = record_chunks(spark, path).repartition("key").sortWithinPartitions("key", "chunk")
    rows = ordered.mapInArrow(_assemble, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, intact boolean")
    return rows.withColumn("page_id", F.col("page_id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long"))


def round_trip(pages: DataFrame) -> DataFrame:
    """The pages written as archives to the shared folder, as read back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path)
    return read_records(spark, path)
