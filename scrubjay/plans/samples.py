"""Files made byte by byte, a row each, whose contents depend on the row's id: what the format kernels are tried on."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels.docx import NAMESPACES as OFFICE
from ..kernels.images import EXIF_HEAD, ICC_HEAD, PHOTOSHOP_HEAD, PNG_SIGNATURE, PNG_XMP, XMP_HEAD, XMP_MORE_HEAD, chunk_bytes
from ..kernels.xmp import NAMESPACES


def directory(entries: list[tuple[int, int, int, bytes]], after: int, values_at: int, order: str = "<") -> tuple[bytes, bytes]:
    """(directory, values) of (tag, type, count, value) entries."""
    rows, values = b"", b""
    for tag, kind, count, value in sorted(entries):
        if len(value) > 4:
            field = struct.pack(order + "I", values_at + len(values))
            values += value + b"\0" * (len(value) % 2)
        else:
            field = value.ljust(4, b"\0")
        rows += struct.pack(order + "HHI", tag, kind, count) + field
    return struct.pack(order + "H", len(entries)) + rows + struct.pack(order + "I", after), values


def exif(i: int) -> bytes:
    """A TIFF block: orientation always; make and artist, location, a serial number and a thumbnail by the id."""
    main = [(0x0112, 3, 1, b"\x06\0"), (0x8769, 4, 1, b"\0\0\0\0")]
    if i % 2 == 0:
        main += [(0x010F, 2, 5, b"Cams\0"), (0x013B, 2, 6, b"Annie\0")]
    if i % 3 == 0:
        main.append((0x8825, 4, 1, b"\0\0\0\0"))
    sub = [(0x829A, 5, 1, struct.pack("<II", 1, 60))]
    if i % 4 == 0:
        sub.append((0xA431, 2, 8, b"SN%05d\0" % (i % 100000)))
    size = lambda entries: 2 + 12 * len(entries) + 4 + sum(len(v) + len(v) % 2 for *_, v in entries if len(v) > 4)
    sub_at = 8 + size(main)
    gps_at = sub_at + size(sub)
    gps = [(1, 2, 2, b"N\0")] if i % 3 == 0 else []
    thumb_at = gps_at + (size(gps) if gps else 0)
    main = [(t, k, n, struct.pack("<I", sub_at if t == 0x8769 else gps_at) if t in (0x8769, 0x8825) else v) for t, k, n, v in main]
    out = b"II" + struct.pack("<HI", 42, 8)
    out += b"".join(directory(main, thumb_at if i % 5 == 0 else 0, 8 + 2 + 12 * len(main) + 4))
    out += b"".join(directory(sub, 0, sub_at + 2 + 12 * len(sub) + 4))
    out += b"".join(directory(gps, 0, gps_at + 18)) if gps else b""
    return out + (b"".join(directory([(0x0103, 3, 1, b"\x06\0")], 0, thumb_at + 18)) if i % 5 == 0 else b"")


def packet(i: int, remote: str | None = None) -> bytes:
    """An XMP packet: a rating always; the tool, a location and a creator by the id."""
    spaces = " ".join(f'xmlns:{p}="{NAMESPACES[p]}"' for p in ("rdf", "dc", "dcterms", "xmp", "exif"))
    given = ' xmp:Rating="5"' + (' xmp:CreatorTool="Tool"' if i % 2 == 0 else "") + (' exif:GPSLatitude="52,1N"' if i % 3 == 0 else "")
    given += f' dcterms:provenance="{remote}"' if remote else ""
    inner = "<dc:creator>Annie</dc:creator>" if i % 4 == 0 else ""
    body = f'<x:xmpmeta xmlns:x="{NAMESPACES["x"]}"><rdf:RDF {spaces}><rdf:Description{given}>{inner}</rdf:Description></rdf:RDF></x:xmpmeta>'
    return b"<?xpacket begin='\xef\xbb\xbf' id='W5M0'?>" + body.encode() + b"<?xpacket end='w'?>"


def segment(marker: int, payload: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(payload) + 2).to_bytes(2, "big") + payload


def jpeg(i: int, packet_: bytes | None = None, store: bool = False) -> bytes:
    parts = [b"\xff\xd8", segment(0xE1, EXIF_HEAD + exif(i)), segment(0xE1, XMP_HEAD + (packet_ or packet(i)))]
    parts += [segment(0xE1, XMP_MORE_HEAD + b"more")] if i % 6 == 0 else []
    parts += [segment(0xE2, ICC_HEAD + b"profile")]
    parts += [segment(0xEB, box())] if store else []
    parts += [segment(0xED, PHOTOSHOP_HEAD + b"8BIM")] if i % 7 == 0 else []
    parts += [segment(0xFE, b"made by Annie")] if i % 2 == 0 else []
    return b"".join(parts) + segment(0xDA, b"scan") + b"\x12\xff\x00\x34" + str(i).encode() + b"\xff\xd9"


def png(i: int) -> bytes:
    rows = zlib.compress(b"\0" + bytes([i % 256]))
    chunks = [(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)), (b"tEXt", b"Title\0kept")]
    chunks += [(b"tEXt", b"Author\0Annie")] if i % 2 == 0 else []
    chunks += [(b"tIME", bytes(7))] if i % 3 == 0 else []
    text = packet(i)
    chunks += [(b"iTXt", PNG_XMP + (b"\0\1\0\0\0" + zlib.compress(text) if i % 2 else b"\0\0\0\0\0" + text)), (b"eXIf", exif(i)), (b"IDAT", rows), (b"IEND", b"")]
    return PNG_SIGNATURE + b"".join(chunk_bytes(k, d) for k, d in chunks)


def part(prefix: str, root: str, inner: str) -> str:
    spaces = " ".join(f'xmlns:{p}="{u}"' for p, u in OFFICE.items())
    return f'<?xml version="1.0" encoding="UTF-8"?><{prefix}:{root} {spaces}>{inner}</{prefix}:{root}>'


def docx(i: int) -> bytes:
    """The parts of a document that may tell who wrote it, by the id."""
    entries = {
        "[Content_Types].xml": "<Types/>",
        "docProps/core.xml": part("cp", "coreProperties", ("<dc:creator>Annie</dc:creator>" if i % 2 == 0 else "") + "<dc:title>T</dc:title><dcterms:created>2024</dcterms:created>"),
        "docProps/app.xml": part("ep", "Properties", ("<ep:Company>Firmco</ep:Company>" if i % 3 == 0 else "") + "<ep:Pages>1</ep:Pages>"),
        "word/settings.xml": part("w", "settings", ("<w:rsids><w:rsidRoot/><w:rsid/></w:rsids>" if i % 4 == 0 else "") + "<w:zoom/>"),
        "word/document.xml": part("w", "document", '<w:ins w:author="Annie">x</w:ins>' if i % 5 == 0 else "<w:p/>"),
        "word/media/a.bin": f"data {i}",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in entries.items():
            archive.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def xref(offsets: list[int]) -> str:
    return f"xref\n0 {len(offsets) + 1}\n0000000000 65535 f \n" + "".join(f"{o:010d} 00000 n \n" for o in offsets)


#: A PDF whose parts have one length whatever the id: # stands for it in nine digits, and each pair of marks for one of two spellings.
PDF_INFO = "3 0 obj\n<< /Title (T #) <A/Author|/Remark> (Ann \\(#\\)) <P/Producer|/Prepared> <41626364> /CreationDate (D:2024) /Cre@61tor 5 0 R >>\nendobj\n"
PDF_XMP = (
    '<?xpacket begin="" id="x"?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" '
    'xmlns:pdf="http://ns.adobe.com/pdf/1.3/" pdf:Producer="P" pdf:Keywords="k" /></rdf:RDF></x:xmpmeta>' + " " * 60 + '<?xpacket end="w"?>'
)


def pdf_info(author: bool, producer: bool) -> str:
    """PDF_INFO with the marks spelled out; its creator's name is written with an escape."""
    return re.sub(r"<([AP])(/\w+)\|(/\w+)>", lambda m: m[2] if (author if m[1] == "A" else producer) else m[3], PDF_INFO)


def pdf(i: int) -> bytes:
    info = pdf_info(i % 2 == 0, i % 3 == 0).replace("#", f"{i:09d}").replace("Cre@", "Cre#")
    parts = ["%PDF-1.4\n", "1 0 obj\n<< /Type /Catalog /Pages 2 0 R /Metadata 4 0 R /AF [] >>\nendobj\n", "2 0 obj\n<< /Type /Pages /Kids [] /Count 0 >>\nendobj\n", info]
    parts += [f"4 0 obj\n<< /Type /Metadata /Subtype /XML /Length {len(PDF_XMP)} >>\nstream\n{PDF_XMP}\nendstream\nendobj\n", f"5 0 obj\n(Tool {i:09d})\nendobj\n"]
    ends = [len("".join(parts[: k + 1])) for k in range(len(parts))]
    return ("".join(parts) + xref(ends[:5]) + f"trailer\n<< /Size 6 /Root 1 0 R /Info 3 0 R >>\nstartxref\n{ends[5]}\n%%EOF\n").encode()


def box() -> bytes:
    """The smallest box that carries a manifest store's label."""
    inner = b"jumd" + b"c2pa" + bytes(12)
    return struct.pack(">I", len(inner) + 8) + b"jumb" + inner


def credentials(i: int) -> bytes:
    if i % 4 == 1:
        return jpeg(i, store=True)
    if i % 4 == 2:
        return jpeg(i, packet(i, f"https://m.example/{i}"))
    return jpeg(i)[:40] if i % 4 == 3 else jpeg(i)


MAKERS = {"pdf": (pdf, ".pdf"), "jpeg": (jpeg, ".jpg"), "png": (png, ".png"), "docx": (docx, ".docx"), "xmp": (packet, ".xmp"), "credentials": (credentials, ".jpg")}


def files(docs: DataFrame, kind: str) -> DataFrame:
    """path (the row's id), suffix, content."""
    make, suffix = MAKERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids = batch.column(0).slice(at, 256).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([str(i) for i in ids]), pa.array([suffix] * len(ids)), pa.array([make(i) for i in ids], pa.binary())], names=["path", "suffix", "content"])

    return docs.select(F.col("doc_id").cast("long")).mapInArrow(run, "path string, suffix string, content binary")
