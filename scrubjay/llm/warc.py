"""WARC: archives as one gzip stream a file, and their normaliser to one gzip member a record with an offset index.

`write_monolithic` stores rows as WARC records, a whole file being a single gzip stream, as careless crawlers do. Such a
file has to be inflated from its start for any record. `normalise` inflates each file once, rewrites every record as a
gzip member of its own and writes a sidecar index of (offset, length, type, record id), so `read_indexed` fetches each
record by one range read.

Each step streams: a task holds one record, or one archive of at most `archive_bytes`. Files get names of their own for
every attempt and are renamed when complete; only the manifest, a table that Spark commits, makes them part of the
result, so a lost executor leaves at most orphans in the scratch folder.

Defined cases: a null payload is an empty one; of records with equal payloads that with the largest id is the response
and others revisit it (rows that repeat that id are responses too); a null id sorts below all others and cannot be
referred to; a null url gives a record without target; control characters in a url are percent-encoded; an empty table
gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import file_system, publish, stored

RECORD = "urn:scrubjay:record:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
MANIFEST = pa.schema([("archive", pa.string()), ("records", pa.int64())])


def header_value(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(record_id: str | None, url: str | None, payload: bytes, sha1_hex: str, refers_to: str | None, is_response: bool) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, with the payload's length, and no payload."""
    digest = base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if is_response else http
    fields = [("WARC-Type", "response" if is_response else "revisit"), ("WARC-Record-ID", f"<{RECORD}{'' if record_id is None else record_id}>"), ("WARC-Date", DATE)]
    fields += [("WARC-Target-URI", header_value(url))] if url is not None else []
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if not is_response:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{RECORD}{refers_to}>")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def read_record(stream) -> tuple[dict[str, str], bytes, bytes] | None:
    """(header fields in lower case, block, the record's bytes) of the next record; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record begins here: {line[:40]!r}")
    lines, fields = [line], {}
    while (line := stream.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError("a record's header has no end")
        lines.append(line)
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    size = int(fields["content-length"])
    block = stream.read(size)
    if len(block) < size:
        raise ValueError("a record's block is cut short")
    return fields, block, b"".join([*lines, line, block, b"\r\n\r\n"])


#: Tasks at most that archives are dealt to; beyond, a task takes several, one after the other.
MOST_TASKS = 20_000


def with_responses(pages: DataFrame, folder: str, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """row_id, url, payload, sha1, refers_to, is_response of every row.

    The response of a payload comes from an aggregation of ids and digests alone that is combined before the shuffle, so many copies of one
    payload are no hot group there. Only payloads met more than once are listed, and the list is stored: where it is small, Spark
    broadcasts it and no payload is shuffled; else the adaptive skew join deals a payload's copies to many tasks.
    """
    rows = pages.select(F.col(id_col).alias("row_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload")).withColumn("sha1", F.sha1("payload"))
    first = rows.groupBy("sha1").agg(F.max("row_id").alias("response"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select(F.col("sha1").alias("sha1_of"), "response")
    first = stored(first, f"{folder}/repeated")
    joined = rows.join(first, rows["sha1"] == first["sha1_of"], "left")
    is_response = F.col("response").isNull() | F.col("row_id").eqNullSafe(F.col("response"))
    return joined.select("row_id", "url", "payload", "sha1", F.when(~is_response, F.col("response")).alias("refers_to"), is_response.alias("is_response"))


def write_monolithic(records: DataFrame, folder: str, archive_bytes: int = 64 << 20) -> DataFrame:
    """Write rows of `with_responses` as archives of one gzip stream each; the manifest (archive, records)."""
    records = records.select(F.col("row_id").cast("string"), "url", "payload", "sha1", F.col("refers_to").cast("string"), "is_response")

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, packer, count, size = None, None, 0, 0

        def closed() -> pa.RecordBatch:
            sink.write(packer.flush())
            name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
            publish(name, sink.getvalue())
            return pa.RecordBatch.from_pydict({"archive": [name], "records": [count]}, MANIFEST)

        for batch in batches:
            for i in range(batch.num_rows):
                if sink is None:
                    sink, packer, count, size = io.BytesIO(), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                data = record(*(batch.column(k)[i].as_py() for k in range(6)))
                sink.write(packer.compress(data))
                count, size = count + 1, size + len(data)
                if size >= archive_bytes:
                    yield closed()
                    sink = None
        if sink is not None:
            yield closed()

    return records.mapInArrow(archives, "archive string, records long")


def normalise(manifest: DataFrame, folder: str, files: int) -> DataFrame:
    """Rewrite each archive of the manifest with one member a record and its sidecar index; the new manifest."""

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                system, path = file_system(source)
                out, index, offset = io.BytesIO(), [], 0
                with system.open_input_stream(path, compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) as stream:
                    while (found := read_record(stream)) is not None:
                        fields, _, data = found
                        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = packer.compress(data) + packer.flush()
                        out.write(member)
                        index.append(json.dumps([offset, len(member), fields.get("warc-type", ""), fields.get("warc-record-id", "")]))
                        offset += len(member)
                name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                publish(name, out.getvalue())
                publish(f"{name}.idx", "\n".join(index).encode())
                yield pa.RecordBatch.from_pydict({"archive": [name], "records": [len(index)]}, MANIFEST)

    return manifest.select("archive").repartition(min(files, MOST_TASKS)).mapInArrow(rewritten, "archive string, records long")


def read_index(name: str) -> list[tuple[int, int, str, str]]:
    system, path = file_system(f"{name}.idx")
    with system.open_input_stream(path, compression=None) as f:
        return [tuple(json.loads(line)) for line in f.read().splitlines()]


def read_member(handle, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Header fields and block of the record whose gzip member lies at the given place of an open archive."""
    fields, block, _ = read_record(io.BytesIO(zlib.decompress(handle.read_at(length, offset), 31)))
    return fields, block


ROWS = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def read_indexed(manifest: DataFrame, files: int, with_payload: bool = True) -> DataFrame:
    """Every record of normalised archives, by range reads from the index. Payloads are checked against their digests.

    payload is null for revisits, and for all without with_payload; payload_bytes is the full payload's for revisits too.
    """

    def ids(value: str) -> str | None:
        return value.strip("<>").removeprefix(RECORD) or None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, path = file_system(name)
                with system.open_input_file(path) as handle:
                    out, held = [], 0
                    for offset, length, _, _ in read_index(name):
                        fields, block = read_member(handle, offset, length)
                        head, _, payload = block.partition(b"\r\n\r\n")
                        declared = int(re.search(rb"(?i)\r\nContent-Length:\s*(\d+)", head)[1])
                        digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                        if kind == "response" and (len(payload) != declared or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"{name} at {offset}: the payload does not match its digest")
                        keep = payload if with_payload and kind == "response" else None
                        out.append((ids(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, ids(fields.get("warc-refers-to", "")), keep, declared, digest))
                        held += len(keep or b"") + 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(ROWS.names, r, strict=True)) for r in out], ROWS)
                            out, held = [], 0
                    if out:
                        yield pa.RecordBatch.from_pylist([dict(zip(ROWS.names, r, strict=True)) for r in out], ROWS)

    return manifest.select("archive").repartition(min(files, MOST_TASKS)).mapInArrow(rows, "record_id string, url string, record_type string, refers_to string, payload binary, payload_bytes long, payload_digest string")


def archive(spark: SparkSession, pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> tuple[DataFrame, int]:
    """Write all rows as whole-stream archives, normalise them; the manifest of the normalised ones and their number."""
    whole = stored(write_monolithic(with_responses(pages, folder, id_col, url_col, payload_col), f"{folder}/whole"), f"{folder}/whole-manifest")
    files = max(1, whole.count())
    manifest = stored(normalise(whole, f"{folder}/members", files), f"{folder}/manifest")
    return manifest, files
