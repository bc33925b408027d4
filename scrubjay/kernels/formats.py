"""From bytes to a format, its scrubber, and what its bytes say about credentials."""

from __future__ import annotations

import io
import re
import zipfile
from typing import NamedTuple

from . import images
from .base import Malformed, Policy, Scrubbed
from .bib import scrub_bib
from .docx import scrub_docx
from .images import scrub_jpeg, scrub_png
from .pdf import Unreadable, scrub_pdf
from .tex import scrub_tex
from .xmp import provenance_url

UNPARSED_CONTAINER = "C2PA data found in a container the SDK cannot parse"
LABEL_WINDOW = 64
ENTRY_BLOCK = 1 << 20


class Facts(NamedTuple):
    """What the bytes of a file say about its provenance."""

    embedded: bool = False
    remote_url: str | None = None
    unrecognized: str | None = None


def box_with_label(data: bytes) -> bool:
    """A box of type jumb with the c2pa label near, whose length can be one. Lengths that can't be read count as plausible."""
    for m in re.finditer(b"jumb", data):
        start = m.start() - 4
        size = int.from_bytes(data[start : m.start()], "big") if start >= 0 else 0
        if b"c2pa" in data[m.start() : m.start() + LABEL_WINDOW] and (size < 2 or 8 <= size <= len(data) - start):
            return True
    return False


def entry_has_label(archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> bool:
    """Whether an entry holds a labelled box, read block by block: an entry may unfold to far more than its archive."""
    kept, begins = b"", 0  # what is left of the blocks before, and where in the entry it begins
    with archive.open(info) as stream:
        while True:
            block = stream.read(ENTRY_BLOCK)
            kept += block
            for m in re.finditer(b"jumb", kept):
                if block and m.start() + LABEL_WINDOW > len(kept):
                    break  # its window goes on in the next block
                start = m.start() - 4
                size = int.from_bytes(kept[start : m.start()], "big") if start >= 0 else 0
                if b"c2pa" in kept[m.start() : m.start() + LABEL_WINDOW] and (size < 2 or 8 <= size <= info.file_size - begins - start):
                    return True
            if not block:
                return False
            cut = max(0, len(kept) - LABEL_WINDOW - 8)
            kept, begins = kept[cut:], begins + cut


def archive_has_label(data: bytes) -> bool:
    """Entries of a zip archive by name and by content; one that can't be read counts."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            return any(b"c2pa" in info.filename.lower().encode() or entry_has_label(archive, info) for info in archive.infolist())
    except Exception:
        return True


def facts_of(data: bytes, kind: str | None) -> Facts:
    """Doubt counts as credentials: a picture that can't be parsed is unrecognized, not clean."""
    try:
        if kind == "jpeg":
            parts = [(m, p) for m, _, p in images.segments(data)]
            packets = [p[len(images.XMP_HEAD) :] for m, p in parts if m == images.APP1 and p.startswith(images.XMP_HEAD)]
            embedded = any(m == images.APP11 and (b"jumb" in p or b"c2pa" in p) for m, p in parts)
        elif kind == "png":
            parts = list(images.chunks(data))
            packets = [b for k, b in parts if k in images.PNG_TEXT and b.startswith(images.PNG_XMP)]
            packets = [b[b.find(b"<") :] if b"<" in b else inflated(b) for b in packets]
            embedded = any(k == b"caBX" for k, _ in parts)
        else:
            found = archive_has_label(data) if zipfile.is_zipfile(io.BytesIO(data)) else box_with_label(data)
            return Facts(unrecognized=UNPARSED_CONTAINER if found else None)
    except Malformed as exc:
        return Facts(unrecognized=str(exc)[:200])
    return Facts(embedded, next((u for u in map(provenance_url, packets) if u), None))


def inflated(body: bytes) -> bytes:
    import zlib

    try:
        return zlib.decompress(body[len(images.PNG_XMP) + 3 :].split(b"\0", 2)[-1])
    except (zlib.error, IndexError):
        return b"provenance?"


class Unsupported(ValueError):
    pass


def scrub(data: bytes, kind: str | None, suffix: str, policy: Policy) -> Scrubbed:
    if kind == "jpeg":
        return scrub_jpeg(data, policy)
    if kind == "png":
        return scrub_png(data, policy)
    if kind == "docx":
        return scrub_docx(data, policy)
    if kind == "bibtex":
        return scrub_bib(data, policy)
    if kind in ("latex", "latex-package", "latex-docstrip"):
        return scrub_tex(data, policy, kind)
    if kind == "pdf":
        try:
            return scrub_pdf(data, policy)
        except Unreadable as exc:
            raise Unsupported(f"{exc} (nothing was changed)") from exc
    raise Unsupported(f"unsupported file type: {suffix or 'unknown'}")
