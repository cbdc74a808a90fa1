"""WARC archives as a table of record chunks.

A record is stored as rows (archive, record, chunk, data, running): its bytes in
slices of bounded size, each with the SHA-1 of all record bytes up to its end. The
concatenation in order of a record's ``data`` is the record as WARC/1.1 has it, and
that of an archive's records is a WARC file. Pages are cut into slices before they reach
the writer, which carries the digest from slice to slice; the reader does likewise. Which
records are revisits is found from digests alone, without payloads.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Bytes of payload in a chunk: a batch of them stays far below a task's memory.
CHUNK = 16 << 10
_END = b"\r\n\r\n"
_TABLE = pa.schema([("archive", pa.int64()), ("record", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary()), ("running", pa.binary())])
_FOUND = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_DATE = "2024-01-01T00:00:00Z"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(page_id: int | None, digest: str, place: int | None = None) -> str:
    """Of a page and its payload; with the record's place where several would share it."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}{'' if place is None else f':{place}'}>"


def header(page_id, url, size: int, digest: str, refers_to, place: int | None = None) -> bytes:
    """All of a record that precedes its payload."""
    http = _HTTP.format(size).encode()
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id, digest, place)}", f"WARC-Date: {_DATE}"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to, digest)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (size if refers_to is None else 0)}"]
    return "\r\n".join(lines).encode() + _END + http


def _write(batches):
    """Slices (page_id, url, sha1, size, refers_to, shared, chunk, last, part), those of a
    record in a row, as rows of the chunk table."""
    archive = TaskContext.get().partitionId()
    record, running = archive << 40, hashlib.sha1()

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _TABLE)], schema=_TABLE)

    for batch in batches:
        fields = (batch.column(c).to_pylist() for c in ("page_id", "url", "sha1", "size", "refers_to", "shared", "chunk", "last"))
        rows: list[tuple] = []
        held = 0
        for i, url, hexed, size, to, shared, k, last, part in zip(*fields, batch.column("part")):
            head = b""
            if not k:
                running = hashlib.sha1()
                head = header(i, url, size, base64.b32encode(bytes.fromhex(hexed)).decode(), to, record if shared else None)
            data = b"".join((head, part.as_buffer(), _END if last else b""))
            running.update(data)
            rows.append((archive, record, k, data, running.digest()))
            held += len(data)
            if held >= 8 << 20:
                yield table(rows)
                rows, held = [], 0
            record += last
        if rows:
            yield table(rows)


def archive_pages(pages: DataFrame, least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of a record for each row of (page_id, url, html).

    Of rows with equal html of ``least`` bytes or more, the smallest page_id has the
    response (each row that has it, if rows repeat) and the others revisit it; smaller
    ones are all responses. Null html is empty; a null page_id is never referred to.
    Records that share page and payload have their place in their ids. An empty table
    gives none; other columns are not read.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("size"))
    # page and digest decide; of most rows nothing is to be told, and they are not joined to anything large
    pairs = settle(rows.groupBy("page_id", "sha1", "size").agg(F.count(F.lit(1)).alias("n")), "digests")
    first = pairs.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.sum("n").alias("copies")).filter("copies > 1")
    told = pairs.join(first, "sha1", "left")
    refers = F.when((F.col("size") >= least) & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    told = told.select(F.col("page_id").alias("its_id"), F.col("sha1").alias("its_sha1"), refers.alias("refers_to"), ((F.col("n") > 1) | F.col("page_id").isNull()).alias("shared"))
    told = settle(told.filter("refers_to is not null or shared"), "revisits")
    rows = rows.join(told, F.col("page_id").eqNullSafe(F.col("its_id")) & (F.col("sha1") == F.col("its_sha1")), "left")
    kept = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(kept) / F.lit(chunk))).cast("int")
    slices = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(kept, k * chunk + 1, F.lit(chunk)))
    cut = rows.select("page_id", "url", "sha1", "size", "refers_to", F.coalesce("shared", F.lit(False)).alias("shared"), n.alias("n"), F.posexplode(slices).alias("chunk", "part"))
    cut = cut.withColumn("last", F.col("chunk") == F.col("n") - 1)
    return cut.mapInArrow(_write, "archive long, record long, chunk long, data binary, running binary")


class Reader:
    """One record, fed chunk by chunk."""

    def __init__(self):
        self.running, self.payload, self.head = hashlib.sha1(), hashlib.sha1(), b""
        self.fields: dict[str, str] | None = None
        self.chunk = self.left = self.size = 0
        self.tail = b""

    def feed(self, chunk: int, data: bytes, running: bytes) -> None:
        self.running.update(data)
        if chunk != self.chunk or self.running.digest() != running:
            raise ValueError("a WARC record has lost or damaged chunks")
        self.chunk += 1
        if self.fields is None:
            self.head += data
            if self.head.count(_END) < 2:
                return
            top, http, data = self.head.split(_END, 2)
            read = lambda x: dict(line.split(": ", 1) for line in x.decode().split("\r\n")[1:])
            self.fields, web = read(top), read(http)
            self.size, self.head = int(web["Content-Length"]), b""
            self.left = int(self.fields["Content-Length"]) - len(http) - len(_END)
        body = data[: self.left]
        self.payload.update(body)
        self.left -= len(body)
        self.tail += data[len(body) :]

    def close(self) -> tuple:
        if self.fields is None or self.left or self.tail != _END:
            raise ValueError("a WARC record ends early")
        named = lambda x: int(x.split(":")[2]) if x and x.split(":")[2] else None
        kind, digest = self.fields["WARC-Type"], self.fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and base64.b32encode(self.payload.digest()).decode() != digest:
            raise ValueError("a WARC payload does not match its digest")
        return named(self.fields["WARC-Record-ID"]), self.size, digest, kind, named(self.fields.get("WARC-Refers-To"))


def _read(batches):
    record, reader, rows = None, None, []
    for batch in batches:
        for r, k, data, running in zip(batch.column("record").to_pylist(), batch.column("chunk").to_pylist(), batch.column("data"), batch.column("running").to_pylist()):
            if r != record:
                if reader:
                    rows.append(reader.close())
                record, reader = r, Reader()
            reader.feed(k, data.as_py(), running)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FOUND)], schema=_FOUND)
            rows = []
    if reader:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*[reader.close()]), _FOUND)], schema=_FOUND)


def read_archives(chunks: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record,
    checked against running and payload digests on the way."""
    ordered = chunks.select("record", "chunk", "data", "running").repartition("record").sortWithinPartitions("record", "chunk")
    return ordered.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, least: int = 0, chunk: int = CHUNK) -> DataFrame:
    return read_archives(settle(archive_pages(pages, least, chunk), "warc", "zstd"))


def export(chunks: DataFrame, folder: str) -> DataFrame:
    """Write one .warc file an archive into a folder that all executors mount, which must
    be there: a task that does not see it fails. Returns (path, n_bytes) of each. A file
    is written under another name and then renamed, so a task that runs again leaves one."""

    def run(batches):
        name = out = None
        done = []

        def close():
            if out:
                n = out.tell()
                out.close()
                path = f"{folder}/{name:08d}.warc"
                os.replace(out.name, path)
                done.append((path, n))

        for batch in batches:
            for a, data in zip(batch.column("archive").to_pylist(), batch.column("data")):
                if a != name:
                    close()
                    name, out = a, open(f"{folder}/.{a:08d}.{uuid.uuid4().hex}", "wb")  # noqa: SIM115
                out.write(data.as_buffer())
        close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "n_bytes"])

    ordered = chunks.repartition("archive").sortWithinPartitions("archive", "record", "chunk")
    return ordered.select("archive", "data").mapInArrow(run, "path string, n_bytes long")
