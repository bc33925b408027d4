"""XMP packets: identity properties go as attributes or elements; the link to a remote manifest never does."""

from __future__ import annotations

import re
from xml.etree import ElementTree

from .base import Removal

# Namespaces and properties.
NAMESPACES = {
    "x": "adobe:ns:meta/",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "dc": "http://purl.org/dc/elements/1.1/",
    "dcterms": "http://purl.org/dc/terms/",
    "xmp": "http://ns.adobe.com/xap/1.0/",
    "xmpMM": "http://ns.adobe.com/xap/1.0/mm/",
    "pdf": "http://ns.adobe.com/pdf/1.3/",
    "photoshop": "http://ns.adobe.com/photoshop/1.0/",
    "exif": "http://ns.adobe.com/exif/1.0/",
    "tiff": "http://ns.adobe.com/tiff/1.0/",
    "Iptc4xmpCore": "http://iptc.org/std/Iptc4xmpCore/1.0/xmlns/",
}
IDENTITY = ("dc:creator", "xmp:CreatorTool", "xmpMM:History", "xmpMM:DocumentID", "xmpMM:InstanceID", "xmpMM:OriginalDocumentID", "photoshop:AuthorsPosition", "tiff:Make", "tiff:Model", "Iptc4xmpCore:CreatorContactInfo")
DATES = ("xmp:CreateDate", "xmp:ModifyDate", "xmp:MetadataDate")
PROVENANCE = "dcterms:provenance"

BEGIN = re.compile(rb"<\?xpacket begin=.*?\?>", re.S)
END = re.compile(rb"<\?xpacket end=.*?\?>", re.S)


def expanded(name: str) -> str:
    prefix, _, local = name.partition(":")
    return f"{{{NAMESPACES[prefix]}}}{local}"


def safe_tree(body: bytes) -> ElementTree.Element:
    """Parsed XML; documents with a type or entity declaration are not parsed at all."""
    if re.search(rb"<!\s*(?:DOCTYPE|ENTITY)", body, re.I) or b"\0" in body:
        raise ValueError("declarations are not allowed")
    return ElementTree.fromstring(body)


def frame(raw: bytes) -> tuple[int, int]:
    """Where the packet's body begins and ends."""
    head, tail = BEGIN.search(raw), END.search(raw)
    return (head.end() if head else 0), (tail.start() if tail else len(raw))


def provenance_url(raw: bytes) -> str | None:
    """What dcterms:provenance says, whether or not the packet is well-formed."""
    name, (start, end) = expanded(PROVENANCE), frame(raw)
    try:
        for element in safe_tree(raw[start:end]).iter():
            if name in element.attrib:
                return element.attrib[name]
            if element.tag == name:
                return (element.text or "").strip() or element.get(expanded("rdf:resource")) or "<unparsed>"
    except Exception:
        return "<unparsed>" if b"provenance" in raw else None
    return None


def scrub_xmp(raw: bytes, strip_dates: bool = False, names: tuple[str, ...] | None = None, where: str = "XMP", location: bool = True) -> tuple[bytes, list[Removal]]:
    """The packet without what identifies; unchanged where it can't be parsed. names: the properties that go, if not the usual ones."""
    start, end = frame(raw)
    try:
        root = safe_tree(raw[start:end])
    except Exception:
        return raw, []
    named = {expanded(n): n for n in (names or (*IDENTITY, *(DATES if strip_dates else ())))}
    place = expanded("exif:GPS")
    attributes, elements = [], []

    def removal(key: str) -> Removal | None:
        if key in named:
            return Removal(where, named[key])
        return Removal(where, key.partition("}")[2], "location") if location and key.startswith(place) else None

    for element in root.iter():
        for key in [k for k in element.attrib if removal(k)]:
            del element.attrib[key]
            attributes.append(removal(key))
    for element in root.iter():
        for child in [c for c in element if isinstance(c.tag, str) and removal(c.tag)]:
            element.remove(child)
            elements.append(removal(child.tag))
    if not attributes and not elements:
        return raw, []
    for prefix, uri in NAMESPACES.items():
        ElementTree.register_namespace(prefix, uri)
    return raw[:start] + ElementTree.tostring(root, encoding="utf-8", xml_declaration=False) + raw[end:], attributes + elements
