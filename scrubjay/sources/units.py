"""Parts of files as rows: JPEG segments, PNG chunks, EXIF entries, XMP properties, zip entries, TeX spans, BibTeX fields."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_type

from ..kernels import bib, exif, images, tex, xmp
from ..kernels.base import Malformed
from ..operators.scrub import small
from ..session import small_batches


def exploded(files: DataFrame, parts: Callable[[bytes], Iterator[tuple]], columns: str) -> DataFrame:
    """path, seq and the columns of each part of each row's content, and `error` where it is malformed from there on."""
    schema = f"path string, seq int, {columns}, error string"
    types = [to_arrow_type(f.dataType) for f in StructType.fromDDL(columns).fields]
    names = StructType.fromDDL(schema).fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small(batches, 1):
            rows = []
            for path, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                seq = 0
                try:
                    for values in parts(content or b""):
                        rows.append((path, seq, *values, None))
                        seq += 1
                except (Malformed, zipfile.BadZipFile, ValueError) as exc:
                    rows.append((path, seq, *(None,) * len(types), str(exc)))
            columns_ = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns_, [pa.string(), pa.int32(), *types, pa.string()], strict=True)], names=names)

    small_batches(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, schema)


def jpeg_segments(files: DataFrame) -> DataFrame:
    return exploded(files, lambda d: ((m, p) for m, _, p in images.segments(d) if m is not None), "marker int, payload binary")


def png_chunks(files: DataFrame) -> DataFrame:
    return exploded(files, lambda d: ((k.decode("latin-1"), b) for k, b in images.chunks(d)), "type string, data binary")


def exif_entries(files: DataFrame) -> DataFrame:
    """content is a bare TIFF block, or a JPEG or PNG that holds one."""

    def block(data: bytes) -> bytes:
        if data[:2] == b"\xff\xd8":
            return next((p[len(images.EXIF_HEAD) :] for m, _, p in images.segments(data) if m == images.APP1 and p.startswith(images.EXIF_HEAD)), b"")
        if data.startswith(images.PNG_SIGNATURE):
            return next((b for k, b in images.chunks(data) if k == b"eXIf"), b"")
        return data

    def parts(data: bytes) -> Iterator[tuple]:
        found = block(data)
        return iter([(where, e.tag, e.type, e.count, e.value) for where, e in exif.entries_of(found)] if found else [])

    return exploded(files, parts, "ifd string, tag int, type int, count long, value binary")


def xmp_properties(files: DataFrame) -> DataFrame:
    """content is a packet. kind is attribute or element."""

    def parts(data: bytes) -> Iterator[tuple]:
        start, end = xmp.frame(data)
        for element in xmp.safe_tree(data[start:end]).iter():
            uri, _, local = element.tag.rpartition("}")
            yield "element", uri.lstrip("{"), local, (element.text or "").strip()
            for key, value in element.attrib.items():
                uri, _, local = key.rpartition("}")
                yield "attribute", uri.lstrip("{"), local, value

    return exploded(files, parts, "kind string, ns string, local string, value string")


def zip_entries(files: DataFrame) -> DataFrame:
    def parts(data: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            for info in archive.infolist():
                yield info.filename, archive.read(info)

    return exploded(files, parts, "entry string, payload binary")


def tex_spans(files: DataFrame) -> DataFrame:
    return exploded(files, lambda d: ((s.kind, s.start, s.end, s.line, s.name) for s in tex.spans(d)), "kind string, start int, end int, line int, name string")


def bib_fields(files: DataFrame) -> DataFrame:
    return exploded(files, bib.fields, "entry int, name string, start int, end int")
