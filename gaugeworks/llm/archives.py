"""WARC records in ZIP-packaged archives: a writer, and a reader that takes records out
by range reads without extracting anything.

An archive is a ZIP file with stored members: archive/data.warc.gz, in which every
record is a gzip member of its own, and indexes/index.cdxj, which has each record's
place. The reader finds the end-of-central-directory record (and the ZIP64 one where
a field overflows), reads the central directory, and from there the index and records.
Archives lie in the shared folder; those that a failed task left are in no manifest
and so never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.shared import materialize, partitions, shared_folder, slices

#: Equal payloads of this many bytes or more are written once.
LEAST_BYTES = 1000
#: Payload bytes after which an archive is closed; bytes of records read at once.
ARCHIVE_BYTES, READ_BYTES = 32 << 20, 1 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


class Member(NamedTuple):
    """A member of a ZIP archive; offset: of its local header."""

    name: str
    method: int
    size: int
    stored: int
    offset: int


def open_shared(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def directory(file) -> list[Member]:
    """Members of a seekable ZIP file, from its central directory."""
    size = file.size()
    tail_at = max(0, size - 22 - 65535 - 20)
    file.seek(tail_at)
    tail = file.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP archive")
    count, length, at = struct.unpack_from("<10xHII", tail, end)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07" and (count == 0xFFFF or 0xFFFFFFFF in (length, at)):
        (zip64_at,) = struct.unpack_from("<8xQ", tail, end - 20)
        file.seek(zip64_at)
        record = file.read(56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory where its locator points")
        count, length, at = struct.unpack_from("<32xQQQ", record)
    file.seek(at)
    data, out, i = file.read(length), [], 0
    for _ in range(count):
        if data[i : i + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, stored, plain, names, extras, comments, offset = struct.unpack_from("<10xH8xIIHHH8xI", data, i)
        name = data[i + 46 : i + 46 + names].decode()
        extra = data[i + 46 + names : i + 46 + names + extras]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                stored = next(wide) if stored == 0xFFFFFFFF else stored
                offset = next(wide) if offset == 0xFFFFFFFF else offset
            extra = extra[4 + n :]
        out.append(Member(name, method, plain, stored, offset))
        i += 46 + names + extras + comments
    return out


def data_offset(file, member: Member) -> int:
    """Where a stored member's bytes begin: its local header has name and extra lengths
    of its own."""
    if member.method:
        raise ValueError(f"{member.name} is compressed and can't be read by ranges")
    file.seek(member.offset)
    head = file.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header of {member.name}")
    names, extras = struct.unpack_from("<26xHH", head)
    return member.offset + 30 + names + extras


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A WARC record: a revisit has the response's headers and no payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    body = _HEAD.format(len(payload)).encode() + (b"" if revisit else payload)
    head = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%')}"] if url else []
    head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if revisit else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """Fields of a record, of its HTTP headers, and its payload (None in a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    fields["http"] = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    fields["payload"] = None if fields["WARC-Type"] == "revisit" else payload
    return fields


def revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload another page with a larger
    id has too. Rows that share the largest id are all responses; null ids are the
    smallest. Only ids and digests are shuffled, and a digest's maximum is combined
    before it."""
    narrow = pages.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("n")).where(F.col("n") >= least_bytes).select("page_id", "digest")
    last = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("times")).where("times > 1").drop("times")
    return narrow.join(last, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archives of a WARC record per row; returns the manifest (path, records), written
    out. A null payload is empty; a null id is written as None and a null URL left out;
    an empty table has an empty manifest."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("html"))
    again = revisits(rows, least_bytes).withColumnsRenamed({"page_id": "r_id", "digest": "r_digest"})
    same = F.col("page_id").eqNullSafe(F.col("r_id")) & (F.sha1("html") == F.col("r_digest"))
    told = rows.join(again, same, "left").select("page_id", "url", "html", F.col("r_digest").isNotNull().alias("revisit"), "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, k = TaskContext.get(), 0
        held, index, size = io.BytesIO(), [], 0

        def close() -> pa.RecordBatch:
            nonlocal held, index, size, k
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                z.writestr(zipfile.ZipInfo(DATA), held.getbuffer())
                z.writestr(zipfile.ZipInfo(INDEX), "".join(f"{json.dumps(x)}\n" for x in index))
            path = f"{folder}/{context.partitionId():06d}-{k:04d}-{context.taskAttemptId()}.wacz"
            store, name = open_shared(path)
            store.create_dir(name.rpartition("/")[0])
            with store.open_output_stream(name) as f:
                f.write(out.getbuffer())
            told = pa.record_batch([pa.array([path]), pa.array([len(index)], pa.int64())], ["path", "records"])
            held, index, size, k = io.BytesIO(), [], 0, k + 1
            return told

        for b in slices(batches, "html"):
            for row in b.to_pylist():
                payload = row["html"].encode()
                at = held.tell()
                held.write(gzip.compress(record(row["page_id"], row["url"], payload, row["refers_to"], row["revisit"], date), 3, mtime=0))
                index.append({"id": row["page_id"], "offset": at, "length": held.tell() - at})
                size += len(payload)
                if size >= archive_bytes:
                    yield close()
        if index:
            yield close()

    return materialize(told.mapInArrow(run, "path string, records long"), "manifest")


def places(manifest: DataFrame) -> DataFrame:
    """(path, offset, length): the byte ranges of all records, from the archives' indexes;
    neighbours in an archive come as one range of READ_BYTES or so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                store, name = open_shared(path)
                with store.open_input_file(name) as f:
                    members = {m.name: m for m in directory(f)}
                    base = data_offset(f, members[DATA])
                    f.seek(data_offset(f, members[INDEX]))
                    entries = sorted((e["offset"], e["length"]) for e in map(json.loads, f.read(members[INDEX].size).splitlines()))
                ranges: list[list[int]] = []
                for at, n in entries:
                    if ranges and ranges[-1][0] + ranges[-1][1] == at and ranges[-1][1] < READ_BYTES:
                        ranges[-1][1] += n
                    else:
                        ranges.append([at, n])
                yield pa.record_batch([pa.array([path] * len(ranges)), pa.array([base + a for a, _ in ranges], pa.int64()), pa.array([n for _, n in ranges], pa.int64())], ["path", "offset", "length"])

    return manifest.select("path").repartition(partitions(manifest.sparkSession)).mapInArrow(run, "path string, offset long, length long")


def read(manifest: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of
    every record of the archives in a manifest. Digest and size of a revisit are those of
    its response, from its headers; its payload is null. A payload that doesn't match its
    digest is an error."""

    def number(urn: str | None) -> int | None:
        value = urn[len("<urn:page:") : -1] if urn else "None"
        return None if value == "None" else int(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for b in batches:
            for place in b.to_pylist():
                store, name = open_shared(place["path"])
                with store.open_input_file(name) as f:
                    f.seek(place["offset"])
                    data = f.read(place["length"])
                rows = []
                while data:
                    member = zlib.decompressobj(31)
                    r = parsed(member.decompress(data))
                    data = member.unused_data
                    payload, digest = r["payload"], base64.b32decode(r["WARC-Payload-Digest"][5:])
                    if payload is not None and hashlib.sha1(payload).digest() != digest:
                        raise ValueError(f"{r['WARC-Record-ID']} in {place['path']} doesn't match its digest")
                    size = int(r["http"]["Content-Length"]) if payload is None else len(payload)
                    rows.append((number(r["WARC-Record-ID"]), r.get("WARC-Target-URI"), size, digest.hex(), r["WARC-Type"], number(r.get("WARC-Refers-To")), payload))
                yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    spread = places(manifest).repartition(partitions(manifest.sparkSession))
    return spread.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
