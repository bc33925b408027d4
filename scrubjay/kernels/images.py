"""JPEG segments and PNG chunks. Picture data is copied as it stands; credentials are kept."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from .base import Malformed, Policy, Removal, Scrubbed
from .exif import scrub_exif
from .xmp import scrub_xmp

# Markers, signatures, chunk names, keywords.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
SOS, APP1, APP2, APP11, APP13, COM = 0xDA, 0xE1, 0xE2, 0xEB, 0xED, 0xFE
ALONE = frozenset([0x01, *range(0xD0, 0xDA)])
EXIF_HEAD = b"Exif\0\0"
XMP_HEAD = b"http://ns.adobe.com/xap/1.0/\0"
XMP_MORE_HEAD = b"http://ns.adobe.com/xmp/extension/\0"
PHOTOSHOP_HEAD = b"Photoshop 3.0\0"
ICC_HEAD = b"ICC_PROFILE\0"
PNG_TEXT = (b"tEXt", b"iTXt", b"zTXt")
PNG_XMP = b"XML:com.adobe.xmp"
PNG_KEYWORDS = frozenset([b"Author", b"Comment", b"Source", b"Software", b"Disclaimer", b"Warning", b"Copyright Owner", b"Contact", b"Email", b"URL"])


def segments(data: bytes) -> Iterator[tuple[int | None, bytes, bytes]]:
    """(marker, head, payload) of each segment. From the start of scan on, and for fill bytes, marker is None and head all there is."""
    if data[:2] != b"\xff\xd8":
        raise Malformed("missing SOI")
    yield 0xD8, data[:2], b""
    at = 2
    while at < len(data):
        if data[at] != 0xFF:
            raise Malformed(f"expected marker at {at}")
        if at + 1 >= len(data) or data[at + 1] == 0xFF:
            yield None, data[at : at + 1], b""  # fill
            at += 1
            continue
        marker = data[at + 1]
        if marker in ALONE:
            yield marker, data[at : at + 2], b""
            at += 2
            continue
        if at + 4 > len(data):
            raise Malformed(f"truncated segment header at {at}")
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if size < 2 or at + 2 + size > len(data):
            raise Malformed(f"segment {marker:#x} overruns file")
        if marker == SOS:
            yield None, data[at:], b""
            return
        yield marker, data[at : at + 4], data[at + 4 : at + 2 + size]
        at += 2 + size


def scrub_jpeg(data: bytes, policy: Policy) -> Scrubbed:
    out = Scrubbed(b"")
    pieces: list[bytes] = []

    def put(marker: int, payload: bytes) -> None:
        pieces.append(bytes([0xFF, marker]) + (len(payload) + 2).to_bytes(2, "big") + payload)

    for marker, head, payload in segments(data):
        if marker is None or marker in ALONE:
            pieces.append(head)
        elif marker == APP1 and payload.startswith(EXIF_HEAD):
            block, found = scrub_exif(payload[len(EXIF_HEAD) :], policy)
            out.removals += found
            if block:
                put(marker, EXIF_HEAD + block)
        elif marker == APP1 and payload.startswith(XMP_HEAD):
            packet, found = scrub_xmp(payload[len(XMP_HEAD) :], policy.strip_dates)
            out.removals += found
            put(marker, XMP_HEAD + packet)
        elif marker == APP1 and payload.startswith(XMP_MORE_HEAD):
            out.removals.append(Removal("APP1", "extended XMP packet"))
        elif marker == APP13 and payload.startswith(PHOTOSHOP_HEAD):
            out.removals.append(Removal("APP13", "Photoshop/IPTC resource block"))
        elif marker == COM:
            out.removals.append(Removal("COM", "comment segment"))
        else:
            if marker == APP11:
                out.preserved.append("APP11 (C2PA manifest store)")
            elif marker == APP2 and payload.startswith(ICC_HEAD):
                out.preserved.append("APP2 (ICC colour profile)")
            put(marker, payload)
    out.data = b"".join(pieces)
    return out


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(type, data) of each chunk to the end chunk."""
    if not data.startswith(PNG_SIGNATURE):
        raise Malformed("missing PNG signature")
    at = len(PNG_SIGNATURE)
    while at < len(data):
        if at + 8 > len(data):
            raise Malformed(f"truncated chunk header at {at}")
        size, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + size > len(data):
            raise Malformed(f"truncated chunk {kind!r} at {at}")
        yield kind, data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IEND":
            return


def chunk_bytes(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def scrub_xmp_chunk(kind: bytes, data: bytes, policy: Policy) -> tuple[bytes, list[Removal]]:
    """An iTXt chunk's data with its packet rewritten: keyword, two flags, language, translated keyword, text."""
    parts = data[len(PNG_XMP) + 3 :].split(b"\0", 2)
    if kind != b"iTXt" or len(parts) < 3:
        return data, []
    compressed = data[len(PNG_XMP) + 1]
    try:
        packet = zlib.decompress(parts[2]) if compressed else parts[2]
    except zlib.error:
        return data, []
    new, found = scrub_xmp(packet, policy.strip_dates)
    if not found:
        return data, []
    head = data[: len(data) - len(parts[2])]
    return head + (zlib.compress(new, 9) if compressed else new), found


def scrub_png(data: bytes, policy: Policy) -> Scrubbed:
    out = Scrubbed(b"")
    pieces = [PNG_SIGNATURE]
    for kind, body in chunks(data):
        keyword = body.partition(b"\0")[0] if kind in PNG_TEXT and b"\0" in body else b""
        if kind == b"caBX":
            out.preserved.append("caBX (C2PA manifest store)")
        elif keyword == PNG_XMP:
            body, found = scrub_xmp_chunk(kind, body, policy)
            out.removals += found
        elif keyword in PNG_KEYWORDS:
            out.removals.append(Removal(f"chunk {kind.decode()}", keyword.decode()))
            continue
        elif kind == b"eXIf":
            body, found = scrub_exif(body, policy)
            out.removals += found
            if not body:
                continue
        elif kind == b"tIME" and policy.strip_dates:
            out.removals.append(Removal("chunk tIME", "last-modified timestamp"))
            continue
        pieces.append(chunk_bytes(kind, body))
    out.data = b"".join(pieces)
    return out
