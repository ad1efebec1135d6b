"""WARC archives: written with one gzip member per record, read back record by record.

A record is a header, a block of ``Content-Length`` bytes and two line ends. A response block is an HTTP
header and the payload; a revisit has the HTTP header alone and names the response with the same payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import filesystem, shared_folder, store

SHARED, FILE, CHUNK = 1000, 1 << 28, 1 << 16
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member. Characters of the URL that would break the header are percent-encoded."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>",
            f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
            f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode()) + press.compress(block) + press.compress(b"\r\n\r\n") + press.flush()


def members(stream) -> Iterator[Iterator[bytes]]:
    """The decompressed parts of each gzip member, a chunk at a time."""
    held = stream.read(CHUNK)
    while held:
        state = {"raw": held}

        def member() -> Iterator[bytes]:
            inflate, raw = zlib.decompressobj(31), state["raw"]
            while True:
                yield inflate.decompress(raw, CHUNK)
                if inflate.eof:
                    break
                raw = inflate.unconsumed_tail or stream.read(CHUNK)
                if not raw and not inflate.unconsumed_tail:
                    if rest := inflate.flush():
                        yield rest
                    if inflate.eof:
                        break
                    raise ValueError("the archive ends within a record")
            state["raw"] = inflate.unused_data

        parts = member()
        yield parts
        for _ in parts:
            pass
        held = state["raw"] or stream.read(CHUNK)


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def records(stream) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(header, HTTP header, payload) of each record; lengths, record ends and digests are verified."""
    for parts in members(stream):
        held = b""
        for part in parts:
            held += part
            if (at := held.find(b"\r\n\r\n")) >= 0:
                break
        else:
            raise ValueError("a record without a header")
        if not held.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        head, body = _headers(held[:at]), [held[at + 4:]]
        body.extend(parts)
        block, size = b"".join(body), int(head["content-length"])
        if block[size:] != b"\r\n\r\n":
            raise ValueError(f"{head['warc-record-id']}: the block is not of the stated length")
        block = block[:size]
        if _sha1(head["warc-block-digest"]) != hashlib.sha1(block).hexdigest():
            raise ValueError(f"{head['warc-record-id']}: wrong block digest")
        http, _, payload = block.partition(b"\r\n\r\n")
        if head["warc-type"] == "response" and _sha1(head["warc-payload-digest"]) != hashlib.sha1(payload).hexdigest():
            raise ValueError(f"{head['warc-record-id']}: wrong payload digest")
        yield head, http, payload


def _sha1(field: str) -> str:
    return base64.b32decode(field.removeprefix("sha1:")).hex()


def _page(urn: str) -> int:
    return int(urn.removeprefix("<urn:page:").removesuffix(">"))


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to: for equal payloads of SHARED bytes or more the largest page_id."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).where("page_id IS NOT NULL")
    rows = rows.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("bytes"))
    shared = rows.where(F.col("bytes") >= SHARED).groupBy("digest", "bytes").agg(
        F.max("page_id").alias("last"), F.min("page_id").alias("first")).where("first < last").select("digest", "bytes", "last")
    found = rows.join(shared, ["digest", "bytes"], "left")
    return found.select("page_id", "url", "payload", "digest",
                        F.when(F.col("page_id") < F.col("last"), F.col("last")).alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Write all pages; returns the table of finished files (path, records) and their folder.

    Null html is an empty payload, a null url leaves its header out, rows with a null page_id are left out.
    Repeated rows are written each; all with the largest page_id of a payload are responses. A file gets a
    fresh name and is listed only by the attempt that finished, so a task may run again.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")

    def run(batches):
        fs, path = filesystem(folder)
        out, name, n, size = None, "", 0, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["path", "records"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs.create_dir(path, recursive=True)
                    name = f"{path}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out, n, size = fs.open_output_stream(name, compression=None), 0, 0
                made = record(*row)
                out.write(made)
                n, size = n + 1, size + len(made)
                if size >= FILE:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return store(planned(pages).mapInArrow(run, "path string, records long"), "warcs"), folder


def read(files: DataFrame, folder: str) -> DataFrame:
    """One row per record of the files: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""

    def run(batches):
        fs, _ = filesystem(folder)
        names = [f.split()[0] for f in _FIELDS.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(path, compression=None) as stream:
                    for head, http, payload in records(stream):
                        revisit = head["warc-type"] == "revisit"
                        size = int(_headers(http)["content-length"]) if revisit else len(payload)
                        rows.append((_page(head["warc-record-id"]), size, _sha1(head["warc-payload-digest"]), head["warc-type"],
                                     _page(head["warc-refers-to"]) if revisit else None, head.get("warc-target-uri")))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return files.select("path").repartition(min(1 << 14, max(1, files.count())), "path").mapInArrow(run, _FIELDS)
