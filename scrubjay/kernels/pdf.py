"""PDF files with classic cross-reference tables: what identifies goes from DocInfo and XMP, of every revision kept in the file.

What goes is overwritten in place by as many blanks, so every offset stays and nothing else changes. Files that are encrypted, or that
keep objects or cross-references in compressed streams, are refused as unsupported: what can't be read is not passed as clean.
Embedded and associated files are kept, for they may hold a credentials store.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from .base import Malformed, Policy, Removal, Scrubbed
from .xmp import END, scrub_xmp

# Entries of DocInfo and properties of XMP.
INFO_IDENTITY = ("Author", "Creator", "Producer", "Keywords", "Subject", "Company")
INFO_DATES = ("CreationDate", "ModDate")
XMP_IDENTITY = ("dc:creator", "xmp:CreatorTool", "xmpMM:DocumentID", "xmpMM:InstanceID", "xmpMM:OriginalDocumentID", "pdf:Producer")
XMP_DATES = ("xmp:CreateDate", "xmp:ModifyDate", "xmp:MetadataDate")

BLANK = re.compile(rb"(?:[\x00\t\n\f\r ]|%[^\r\n]*)*")
WORD = re.compile(rb"[^\x00\t\n\f\r ()<>\[\]{}/%]+")
NAME = re.compile(rb"/[^\x00\t\n\f\r ()<>\[\]{}/%]*")
REFERENCE = re.compile(rb"(\d+)[\x00\t\n\f\r ]+(\d+)[\x00\t\n\f\r ]+R(?![^\x00\t\n\f\r ()<>\[\]{}/%])")
OBJECT = re.compile(rb"[\x00\t\n\f\r ]*(\d+)[\x00\t\n\f\r ]+(\d+)[\x00\t\n\f\r ]+obj")
STREAM = re.compile(rb"stream\r?\n")
DEEPEST = 100


class Unreadable(Malformed):
    """A PDF of a kind that is not handled here."""


def past_blank(data: bytes, at: int) -> int:
    return BLANK.match(data, at).end()


def value_end(data: bytes, at: int, depth: int = 0) -> int:
    """Where the object that begins at `at` ends."""
    if depth > DEEPEST:
        raise Malformed("objects are nested too deep")
    if found := REFERENCE.match(data, at):
        return found.end()
    first = data[at : at + 1]
    if first == b"(":
        level = 0
        while at < len(data):
            c = data[at]
            if c == 0x5C:
                at += 1
            elif c == 0x28:
                level += 1
            elif c == 0x29:
                level -= 1
                if not level:
                    return at + 1
            at += 1
        raise Malformed("a string has no end")
    if data[at : at + 2] == b"<<":
        *_, end = (e for *_, e in entries(data, at, depth + 1, ends=True))
        return end
    if first == b"<":
        end = data.find(b">", at)
        if end < 0:
            raise Malformed("a string has no end")
        return end + 1
    if first == b"[":
        at = past_blank(data, at + 1)
        while data[at : at + 1] != b"]":
            at = past_blank(data, value_end(data, at, depth + 1))
        return at + 1
    found = NAME.match(data, at) or WORD.match(data, at)
    if not found:
        raise Malformed(f"no object at {at}")
    return found.end()


def entries(data: bytes, at: int, depth: int = 0, ends: bool = False) -> Iterator[tuple[str, int, int, int]]:
    """(key, its start, its value's start and end) of the dictionary at `at`; with ends, last of all its own end."""
    if data[at : at + 2] != b"<<":
        raise Malformed(f"no dictionary at {at}")
    at = past_blank(data, at + 2)
    while data[at : at + 2] != b">>":
        key = NAME.match(data, at)
        if not key:
            raise Malformed(f"no key at {at}")
        start = past_blank(data, key.end())
        end = value_end(data, start, depth)
        yield re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), key[0][1:]).decode("latin-1"), at, start, end
        at = past_blank(data, end)
    if ends:
        yield "", at, at, at + 2


def dictionary(data: bytes, at: int) -> dict[str, tuple[int, int, int]]:
    return {key: place for key, *place in entries(data, at)}


def revisions(data: bytes) -> Iterator[tuple[dict[int, int], dict[str, bytes]]]:
    """(offset of each object, trailer's entries) of each cross-reference section, the latest first."""
    found = re.findall(rb"startxref[\x00\t\n\f\r ]+(\d+)", data)
    at, seen = int(found[-1]) if found else -1, set()
    while at not in seen:
        seen.add(at)
        if at < 0 or data[at : at + 4] != b"xref":
            raise Unreadable("unsupported PDF: no classic cross-reference table")
        at, places = past_blank(data, at + 4), {}
        while head := re.compile(rb"(\d+) (\d+)[\r\n ]+").match(data, at):
            at, first = head.end(), int(head[1])
            for k in range(int(head[2])):
                line = re.compile(rb"(\d{10}) \d{5} ([nf])[\r\n ]*").match(data, at)
                if not line:
                    raise Malformed("a cross-reference table is cut short")
                if line[2] == b"n":
                    places[first + k] = int(line[1])
                at = line.end()
        if data[at : at + 7] != b"trailer":
            raise Malformed("a cross-reference table has no trailer")
        trailer = {key: data[s:e] for key, _, s, e in entries(data, past_blank(data, at + 7))}
        if "Encrypt" in trailer:
            raise Unreadable("unsupported PDF: encrypted")
        if "XRefStm" in trailer:
            raise Unreadable("unsupported PDF: cross-references in a stream")
        yield places, trailer
        if "Prev" not in trailer:
            return
        at = int(trailer["Prev"])


def object_at(data: bytes, number: int, at: int) -> int:
    """Where the value of the object begins whose header stands at `at`."""
    head = OBJECT.match(data, at)
    if not head or int(head[1]) != number:
        raise Malformed(f"object {number} is not where the cross-reference table says")
    return past_blank(data, head.end())


def blanked(data: bytearray, start: int, end: int, by: bytes = b"") -> None:
    data[start:end] = by.ljust(end - start)


def scrub_pdf(data: bytes, policy: Policy) -> Scrubbed:
    out = Scrubbed(data)
    new = bytearray(data)
    parts = list(revisions(data))
    offsets: dict[int, set[int]] = {}
    for places, _ in parts:
        for number, at in places.items():
            offsets.setdefault(number, set()).add(at)

    def of_reference(value: bytes) -> Iterator[int]:
        found = REFERENCE.match(value)
        for at in sorted(offsets.get(int(found[1]), ())) if found else ():
            yield object_at(data, int(found[1]), at)

    removals: dict[tuple[str, str], Removal] = {}
    wanted = (*INFO_IDENTITY, *(INFO_DATES if policy.strip_dates else ()))
    found: set[str] = set()
    for _, trailer in parts:
        for at in of_reference(trailer.get("Info", b"")):
            for key, start, value, end in entries(data, at):
                if key in wanted:
                    for inner in of_reference(data[value:end]):
                        blanked(new, inner, value_end(data, inner), b"()" if data[inner : inner + 1] in (b"(", b"<") else b"0")
                    blanked(new, start, end)
                    found.add(key)
        for at in of_reference(trailer.get("Root", b"")):
            catalog = dictionary(data, at)
            names = catalog.get("Names")
            holders = [] if not names else [names[1]] if data[names[1] : names[1] + 2] == b"<<" else list(of_reference(data[names[1] : names[2]]))
            if any("EmbeddedFiles" in dictionary(data, h) for h in holders):
                removals.setdefault(("kept", "/EmbeddedFiles (may hold a C2PA manifest)"), None)
            if "AF" in catalog:
                removals.setdefault(("kept", "/AF associated files"), None)
    out.preserved = [note for _, note in removals]
    out.removals = [Removal("PDF DocInfo", key) for key in wanted if key in found]
    seen: list[Removal] = []
    for number, places in sorted(offsets.items()):
        for place in sorted(places):
            at = object_at(data, number, place)
            if data[at : at + 2] != b"<<":
                continue
            own = dictionary(data, at)
            kind = {data[own[k][1] : own[k][2]] for k in ("Type", "Subtype") if k in own}
            if kind & {b"/ObjStm", b"/XRef"}:
                raise Unreadable("unsupported PDF: objects in compressed streams")
            if kind & {b"/Metadata", b"/XML"}:
                seen += scrub_metadata(data, new, at, own, policy)
    out.removals += list(dict.fromkeys(seen))
    out.data = bytes(new)
    return out


def scrub_metadata(data: bytes, new: bytearray, at: int, own: dict[str, tuple[int, int, int]], policy: Policy) -> list[Removal]:
    """Rewrites the XMP stream of a metadata object within its length."""
    body = STREAM.match(data, past_blank(data, value_end(data, at)))
    end = data.find(b"endstream", body.end()) if body else -1
    if end < 0:
        return []
    if "Filter" in own:
        raise Unreadable("unsupported PDF: compressed metadata")
    raw = data[body.end() : end]
    names = (*XMP_IDENTITY, *(XMP_DATES if policy.strip_dates else ()))
    packet, found = scrub_xmp(raw, names=names, where="PDF XMP", location=False)
    if not found and re.search(rb"<!\s*(?:DOCTYPE|ENTITY)", raw, re.I):
        return [Removal("PDF XMP", "packet", "unparseable", False)]
    if len(packet) > len(raw):
        raise Unreadable("unsupported PDF: its metadata has no room to be rewritten")
    if found:
        tail = END.search(packet)
        cut = tail.start() if tail else len(packet)
        new[body.end() : end] = packet[:cut] + b" " * (len(raw) - len(packet)) + packet[cut:]
    return found
