"""Media columns: content-addressed payloads in tar shards, with metadata from header-only range reads.

A payload becomes an 8-bit grey image, losslessly (PNG, one sample a byte). Its content address is the SHA-256 of the stored form, the
member's name in a tar shard; a row carries the digest, the shard, the offset and the length. Within a shard a payload is
stored once; across shards each digest has one canonical place, the least, which an aggregation finds. Width, height and depth
come from a range read of the first bytes only; features come from the whole stored form, read back and checked.

Shards are written under temporary names and renamed when complete, under a name of their own for each attempt; the
manifest, a table that Spark commits, makes them part of the result. A task holds one shard of at most `shard_bytes`.

Defined cases: a null text is an empty one, whose payload is one row of filling; equal texts share a digest and all values;
repeated rows give one row each; other columns are ignored; an empty table gives no shard and an empty result.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import file_system, publish, slices, stored

WIDTH = 576
FILL = b"\xff"
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and image header with their lengths and checksum: all that metadata needs.
HEADER_BYTES = 33
#: Rows a shard may describe, so that endless copies of one payload still close it.
SHARD_ROWS = 50_000


def padded(data: bytes, multiple: int = WIDTH) -> bytes:
    """data and filling up to a positive multiple."""
    return data + FILL * (-len(data) % multiple if data else multiple)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, width: int = WIDTH) -> bytes:
    """Samples in rows of `width`, 8-bit grey; every row has filter 0."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)
    lines[:, 1:] = rows
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def header_of(first: bytes) -> tuple[int, int, int]:
    """(width, height, bits a sample) from the first HEADER_BYTES of an image."""
    if first[:8] != SIGNATURE or first[12:16] != b"IHDR" or zlib.crc32(first[12:29]) != struct.unpack(">I", first[29:33])[0]:
        raise ValueError("no image header")
    return struct.unpack(">IIB", first[16:25])


def from_png(data: bytes) -> bytes:
    """The samples of an image that to_png made."""
    width, height, bits = header_of(data)
    at, packed = 8, b""
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            packed += data[at + 8 : at + 8 + size]
        at += size + 12
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)
    if bits != 8 or lines[:, 0].any():
        raise ValueError("not an image of unfiltered 8-bit samples")
    return lines[:, 1:].tobytes()


class Shard:
    """A tar archive in memory, with its members' digests and places."""

    def __init__(self) -> None:
        self.out, self.places, self.rows = io.BytesIO(), {}, []

    def place(self, data: bytes) -> tuple[str, int, int]:
        digest = hashlib.sha256(data).hexdigest()
        if digest not in self.places:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            self.out.write(info.tobuf(tarfile.USTAR_FORMAT))
            self.places[digest] = (digest, self.out.tell(), len(data))
            self.out.write(data + b"\0" * (-len(data) % 512))
        return self.places[digest]

    def bytes(self) -> bytes:
        return self.out.getvalue() + b"\0" * 1024


ENTRY = "row_id {0}, n_bytes long, digest string, shard string, offset long, length long"


def store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 32 << 20) -> DataFrame:
    """Write every row's payload into tar shards; the manifest: row_id, n_bytes, digest, shard, offset, length."""
    docs = docs.select(F.col(id_col).alias("row_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("body"))
    id_type = dict(docs.dtypes)["row_id"]
    names = ["row_id", "n_bytes", "digest", "shard", "offset", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids = Shard(), []
        last: dict[bytes, tuple[str, int, int]] = {}

        def closed() -> pa.RecordBatch:
            name = f"{folder}/{uuid.uuid4().hex}.tar"
            publish(name, shard.bytes())
            sizes, places = [r[0] for r in shard.rows], [r[1] for r in shard.rows]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(sizes, pa.int64()), pa.array([p[0] for p in places]), pa.array([name] * len(places)), pa.array([p[1] for p in places], pa.int64()), pa.array([p[2] for p in places], pa.int64())], names=names)

        for part in slices(batches, 1, 4 << 20):
            ids.append(part.column(0))
            for data in part.column(1).to_pylist():
                key = hashlib.sha256(data).digest()
                if (place := last.get(key)) is None:
                    place = last[key] = shard.place(to_png(padded(data)))
                shard.rows.append((len(data), place))
            if shard.out.tell() >= shard_bytes or len(shard.rows) >= SHARD_ROWS:
                yield closed()
                shard, ids = Shard(), []
                last.clear()
        if shard.rows:
            yield closed()

    return docs.mapInArrow(run, ENTRY.format(id_type))


def canonical(manifest: DataFrame) -> DataFrame:
    """digest, shard, offset, length: one place of each digest."""
    return manifest.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.shard", "at.offset", "at.length")


def by_shard(places: DataFrame) -> DataFrame:
    return places.select("shard", "offset", "length", "digest").repartition("shard").sortWithinPartitions("shard", "offset")


class Reader:
    """Range reads from shards, with the current one kept open."""

    def __init__(self) -> None:
        self.name, self.handle = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            if self.handle is not None:
                self.handle.close()
            system, path = file_system(name)
            self.name, self.handle = name, system.open_input_file(path)
        return self.handle.read_at(length, offset)


def metadata(places: DataFrame) -> DataFrame:
    """digest, width, height, bits of every place, from the image headers alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            found = [header_of(reader.read(s, o, min(n, HEADER_BYTES))) for s, o, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(3), *(pa.array([f[k] for f in found], pa.int64()) for k in range(3))], names=["digest", "width", "height", "bits"])

    return by_shard(places).mapInArrow(run, "digest string, width long, height long, bits long")


def samples(places: DataFrame) -> DataFrame:
    """The place (digest, shard, offset, length) and payload: the samples read back; the stored form is checked against its address."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            shards, offsets, lengths, digests = (batch.column(k).to_pylist() for k in range(4))
            out, held = [], 0
            for k, (s, o, n, digest) in enumerate(zip(shards, offsets, lengths, digests, strict=True)):
                data = reader.read(s, o, n)
                if hashlib.sha256(data).hexdigest() != digest:
                    raise ValueError(f"{s} at {o}: the member does not match its address")
                out.append((digest, s, o, n, from_png(data)))
                held += len(out[-1][4]) + n
                if held > 8 << 20 or k == len(shards) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=["digest", "shard", "offset", "length", "payload"])
                    out, held = [], 0

    return by_shard(places).mapInArrow(run, "digest string, shard string, offset long, length long, payload binary")


def features(places: DataFrame) -> DataFrame:
    """The place of each distinct payload, with its size, digests and first samples."""
    seen = samples(places)
    tail = F.substring(F.col("payload"), -32, 32)
    return seen.select("digest", "shard", "offset", "length", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), F.hex(F.substring(F.col("payload"), 1, 8)).alias("first_samples"))


def media_columns(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's place and metadata, and the features of what was read back."""
    manifest = stored(store(docs, f"{folder}/shards", id_col, text_col), f"{folder}/manifest")
    places = stored(canonical(manifest), f"{folder}/places")
    facts = stored(features(places).join(metadata(places), "digest"), f"{folder}/features").withColumnRenamed("digest", "of")
    rows = manifest.select("row_id", "n_bytes", "digest")
    # The stored form's address is its digest, and its length the member's: both were checked when it was read.
    out = rows.join(facts, F.col("digest") == F.col("of")).withColumns({"media_bytes": F.col("length"), "media_sha256": F.col("digest")})
    return out.drop("of").withColumnRenamed("row_id", id_col)
