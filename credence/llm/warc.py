"""Web archives: records as gzip members, revisits of equal payloads, and a splittable reader.

The reader's tasks take byte ranges.  A task looks for the first gzip member in its range by its
magic number, checks a candidate by decoding the header of the record, and then owns every record
that starts inside the range, reading past its end for the last one.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, fresh_path, keep

#: Payloads of at least this many bytes are written once.
LEAST_REVISIT = 1000
#: Bytes of a reader's range.
SPLIT = 8 << 20
#: Bytes after which a task begins a new file.
FILE_BYTES = 256 << 20
READ = 1 << 20
MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _clean(value: str) -> str:
    return value.replace("\r", " ").replace("\n", " ")


def record(page_id, url: str | None, payload: bytes, sha1: bytes, refers_to) -> bytes:
    """A WARC record as one gzip member: a response, or a revisit that names the response's record
    and keeps the HTTP header with the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + squeeze.flush()


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write every row of ``pages`` as a record under ``folder``; returns the manifest (file, bytes, records).

    Of rows with equal payloads of at least LEAST_REVISIT bytes, the one with the largest key is the
    response and the others are revisits of it; shorter payloads are all responses.  Only keys and
    digests are grouped, never payloads.  A null payload is an empty one, a null url an empty string;
    rows repeated with one key are records each, and the response among equal ones.  An empty table
    writes no archive.
    """
    rows = columns(pages, key, url, html).toDF("page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumn("sha1", F.sha1("html"))
    groups = rows.where(F.octet_length("html") >= LEAST_REVISIT).groupBy("sha1").agg(F.max("page_id").alias("holder"), F.count("*").alias("n"))
    groups = keep(groups.where("n > 1 and holder is not null").select(F.col("sha1").alias("same"), "holder"), "holders")
    few = F.broadcast(groups) if groups.count() <= 200_000 else groups  # at most 200,000 x 60 bytes
    rows = rows.join(few, F.col("sha1") == F.col("same"), "left")
    rows = rows.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder"))).select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, path = _filesystem(folder)
        filesystem.create_dir(path, recursive=True)
        out, name, size, n = None, "", 0, 0
        for df in batches:
            for page_id, at, text, other in zip(df["page_id"], df["url"], df["html"], df["refers_to"]):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = filesystem.open_output_stream(f"{path}/{name}", compression=None)
                payload = text.encode()
                member = record(None if pd.isna(page_id) else int(page_id), at, payload, hashlib.sha1(payload).digest(), None if pd.isna(other) else int(other))
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= FILE_BYTES:
                    out.close()
                    yield pd.DataFrame([{"file": f"{folder}/{name}", "bytes": size, "records": n}])
                    out = None
        if out is not None:
            out.close()
            yield pd.DataFrame([{"file": f"{folder}/{name}", "bytes": size, "records": n}])

    return keep(rows.mapInPandas(run, "file string, bytes long, records long"), "archives")


class _Source:
    """Bytes of a file from a place on."""

    def __init__(self, handle, size: int):
        self.handle, self.size = handle, size

    def at(self, offset: int, length: int = READ) -> bytes:
        return self.handle.read_at(min(length, self.size - offset), offset) if offset < self.size else b""


def _inflate(src: _Source, at: int, most: int = READ) -> Iterator[tuple[bytes, int | None]]:
    """Decoded stretches of at most ``most`` bytes of the member at ``at``; with the last, where the member ends."""
    engine, offset = zlib.decompressobj(31), at
    while not engine.eof:
        raw = src.at(offset)
        if not raw:
            raise ValueError("a member ends too soon")
        offset += len(raw)
        while raw and not engine.eof:
            data, raw = engine.decompress(raw, most), engine.unconsumed_tail
            yield data, (offset - len(engine.unused_data) if engine.eof else None)


def is_record(src: _Source, at: int) -> bool:
    """Whether a gzip member whose content begins as a WARC record starts here."""
    raw = src.at(at, 4096)
    if raw[:3] != MAGIC:
        return False
    try:
        return zlib.decompressobj(31).decompress(raw, 10).startswith(b"WARC/1.")
    except zlib.error:
        return False


def first_record(src: _Source, start: int, end: int) -> int | None:
    """The first record that starts in [start, end)."""
    at = start
    while at < end:
        window = src.at(at, min(READ, end - at) + len(MAGIC) - 1)
        i = window.find(MAGIC)
        while i >= 0 and at + i < end:
            if is_record(src, at + i):
                return at + i
            i = window.find(MAGIC, i + 1)
        at += READ
    return None


def read_record(src: _Source, at: int, with_payload: bool) -> tuple[dict, int]:
    """The record of the member at ``at`` and the place after it.  The payload's digest is taken from
    its bytes as they come; a payload that doesn't match its header is an error."""
    head, fields, http, sha1, payload, left, size = b"", None, None, hashlib.sha1(), [], 0, 0
    end = at
    for data, stop in _inflate(src, at):
        end = stop if stop is not None else end
        if http is None:
            head += data
            if fields is None and b"\r\n\r\n" in head:
                top, _, head = head.partition(b"\r\n\r\n")
                fields = dict(x.split(": ", 1) for x in top.decode().split("\r\n")[1:])
                left = int(fields["Content-Length"])
            if fields is None or b"\r\n\r\n" not in head:
                continue
            top, _, data = head.partition(b"\r\n\r\n")
            http = dict(x.split(": ", 1) for x in top.decode().split("\r\n")[1:])
            left -= len(top) + 4
        part = data[:left]
        left -= len(part)
        size += len(part)
        sha1.update(part)
        if with_payload:
            payload.append(part)
    if http is None:
        raise ValueError("a record without a header")
    known = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    revisit = fields["WARC-Type"] == "revisit"
    if left or not revisit and (sha1.digest() != known or size != int(http["Content-Length"])):
        raise ValueError("a payload doesn't match its header")
    name = lambda f: int(x) if f in fields and (x := fields[f][10:-1]) else None  # noqa: E731  from <urn:page:N>
    return {
        "page_id": name("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": int(http["Content-Length"]), "payload_digest": known.hex(),
        "record_type": fields["WARC-Type"], "refers_to": name("WARC-Refers-To"), "payload": b"".join(payload) if with_payload and not revisit else None,
    }, end


def read_archives(archives: DataFrame, split: int = SPLIT, with_payload: bool = False) -> DataFrame:
    """Every record of the archives (file, bytes) once, however the files are split."""
    parts = archives.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)).cast("long"), F.lit(split).cast("long"))).alias("start"))
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for file, size, start in zip(df["file"], df["bytes"], df["start"]):
                filesystem, path = _filesystem(file)
                with filesystem.open_input_file(path) as handle:
                    src, end, found, held = _Source(handle, int(size)), min(int(start) + split, int(size)), [], 0
                    at = first_record(src, int(start), end)
                    while at is not None and at < end:
                        one, at = read_record(src, at, with_payload)
                        found.append(one)
                        held += len(one["payload"] or b"")
                        if len(found) >= 5000 or held > 8 * READ:
                            yield pd.DataFrame(found).astype({"page_id": "Int64", "refers_to": "Int64"})
                            found, held = [], 0
                    if found:
                        yield pd.DataFrame(found).astype({"page_id": "Int64", "refers_to": "Int64"})

    return parts.repartition(n).mapInPandas(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read every record back.

    Returns key, payload_bytes, payload_digest (hex SHA-1), record_type and refers_to.  Null html is
    an empty payload.  Rows with a null key refer to the group's response if there is one, and are
    responses otherwise; rows that repeat the response's key and payload are responses too.  An empty
    table gives no archive and an empty result; further columns are not read.
    """
    archives = write_archives(pages, fresh_path(pages.sparkSession, "warc"), key, url, html)
    return read_archives(archives).select(F.col("page_id").alias(key), "payload_bytes", "payload_digest", "record_type", "refers_to")
