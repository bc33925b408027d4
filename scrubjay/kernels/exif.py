"""EXIF: a TIFF block is read into directories, filtered, and laid out anew. What can't be parsed is dropped whole."""

from __future__ import annotations

import struct
from typing import NamedTuple

from .base import Malformed, Policy, Removal

# Tags and type widths.
SUB_IFD, GPS_IFD, INTEROP_IFD = 0x8769, 0x8825, 0xA005
IDENTITY = {
    0x001C: "HostComputer",
    0x00FE: "NewSubfileType",
    0x010F: "Make",
    0x0110: "Model",
    0x0131: "Software",
    0x013B: "Artist",
    0x013C: "HostComputer",
    0x927C: "MakerNote",
    0x9C9C: "XPComment",
    0x9C9D: "XPAuthor",
    0x9C9E: "XPKeywords",
    0xA430: "CameraOwnerName",
    0xA431: "BodySerialNumber",
    0xA433: "LensMake",
    0xA435: "LensSerialNumber",
    0xC62F: "CameraSerialNumber",
}
DATES = {0x0132: "DateTime", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9010: "OffsetTime", 0x9011: "OffsetTimeOriginal", 0x9012: "OffsetTimeDigitized"}
WIDTHS = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


class Entry(NamedTuple):
    tag: int
    type: int
    count: int
    value: bytes


class Tiff:
    """Reader of a block in either byte order; reading past its end is an error."""

    def __init__(self, block: bytes):
        self.block = block
        self.order = {b"II": "<", b"MM": ">"}.get(block[:2])
        if len(block) < 8:
            raise Malformed("too short")
        if self.order is None:
            raise Malformed(f"bad byte order {block[:2]!r}")
        magic, self.first = self.read("HI", 2)
        if magic != 42:
            raise Malformed(f"bad magic {magic}")

    def read(self, kinds: str, at: int) -> tuple:
        try:
            return struct.unpack_from(self.order + kinds, self.block, at)
        except struct.error as exc:
            raise Malformed(f"read past end at {at}") from exc

    def directory(self, at: int) -> tuple[list[Entry], int]:
        """Entries, values fetched, and the place of the next directory."""
        (count,) = self.read("H", at)
        entries = []
        for k in range(count):
            place = at + 2 + 12 * k
            tag, kind, n = self.read("HHI", place)
            size = WIDTHS.get(kind, 1) * n
            where = self.read("I", place + 8)[0] if size > 4 else place + 8
            if where + size > len(self.block):
                raise Malformed(f"value for tag {tag:#x} out of range")
            entries.append(Entry(tag, kind, n, self.block[where : where + size]))
        return entries, self.read("I", at + 2 + 12 * count)[0]

    def pointed(self, entry: Entry) -> tuple[list[Entry], int]:
        return self.directory(struct.unpack(self.order + "I", entry.value[:4].ljust(4, b"\0"))[0])


def laid_out(order: str, directories: list[list[Entry]]) -> bytes:
    """A block of main, Exif and interoperability directories (those that have entries), then the values that don't fit in them."""
    pointers = (None, SUB_IFD, INTEROP_IFD)
    places, at = [], 8
    for entries in directories:
        places.append(at)
        at += 2 + 12 * len(entries) + 4 if entries else 0
    values, out = b"", []
    for k, entries in enumerate(directories):
        if not entries and k:
            continue
        rows = b""
        for entry in sorted(entries, key=lambda e: e.tag):
            value = entry.value
            if k + 1 < len(directories) and entry.tag == pointers[k + 1] and directories[k + 1]:
                entry, value = Entry(entry.tag, 4, 1, b""), struct.pack(order + "I", places[k + 1])
            if len(value) > 4:
                field = struct.pack(order + "I", at + len(values))
                values += value + b"\0" * (len(value) % 2)
            else:
                field = value.ljust(4, b"\0")
            rows += struct.pack(order + "HHI", entry.tag, entry.type, entry.count) + field
        out.append(struct.pack(order + "H", len(entries)) + rows + bytes(4))
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + b"".join(out) + values


def entries_of(block: bytes) -> list[tuple[str, Entry]]:
    """Every entry with the name of its directory: IFD0, Exif, Interop, GPS, IFD1."""
    tiff = Tiff(block)
    main, after = tiff.directory(tiff.first)
    out = [("IFD0", e) for e in main]
    for entry in main:
        if entry.tag == SUB_IFD:
            sub = tiff.pointed(entry)[0]
            out += [("Exif", e) for e in sub]
            out += [("Interop", x) for e in sub if e.tag == INTEROP_IFD for x in tiff.pointed(e)[0]]
        elif entry.tag == GPS_IFD:
            out += [("GPS", e) for e in tiff.pointed(entry)[0]]
    return out + ([("IFD1", e) for e in tiff.directory(after)[0]] if after else [])


def scrub_exif(block: bytes, policy: Policy) -> tuple[bytes, list[Removal]]:
    """The block without identity, location and thumbnail (and dates by policy); empty where it can't be parsed."""
    removals: list[Removal] = []
    try:
        tiff = Tiff(block)
        main, after = tiff.directory(tiff.first)
        if after:
            removals.append(Removal("EXIF", "IFD1 thumbnail", "may predate cropping or redaction"))
        removals += [Removal("EXIF", "GPS IFD", "entire location record") for e in main if e.tag == GPS_IFD]
        sub = next((tiff.pointed(e)[0] for e in main if e.tag == SUB_IFD), [])
        interop: list[Entry] = []
        for entry in [e for e in sub if e.tag == INTEROP_IFD]:
            try:
                interop = tiff.pointed(entry)[0]
            except Malformed:
                interop = []
                sub = [e for e in sub if e is not entry]
        gone = IDENTITY | (DATES if policy.strip_dates else {})
        if any(e.tag == GPS_IFD for e in sub):  # a location pointer has no place there, and goes with a report
            removals.append(Removal("EXIF SubIFD", "GPS IFD", "entire location record"))
        kept = []
        for where, entries in (("EXIF IFD0", main), ("EXIF SubIFD", sub)):
            removals += [Removal(where, gone[e.tag]) for e in entries if e.tag in gone]
            kept.append([e for e in entries if e.tag not in gone and e.tag != GPS_IFD])
        if not kept[1]:
            kept[0] = [e for e in kept[0] if e.tag != SUB_IFD]
        return (laid_out(tiff.order, [*kept, interop if kept[1] else []]), removals) if removals else (block, [])
    except Malformed as exc:
        return b"", [*removals, Removal("EXIF", "entire block", f"unparseable: {exc}")]
