"""Office documents: parts that identify are rewritten, every other entry of the archive is copied as it stands."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

from .base import Policy, Removal, Scrubbed
from .xmp import safe_tree

# Parts, namespaces and elements.
CORE, APP, SETTINGS = "docProps/core.xml", "docProps/app.xml", "word/settings.xml"
NAMESPACES = {
    "cp": "http://schemas.openxmlformats.org/package/2006/metadata/core-properties",
    "dc": "http://purl.org/dc/elements/1.1/",
    "dcterms": "http://purl.org/dc/terms/",
    "ep": "http://schemas.openxmlformats.org/officeDocument/2006/extended-properties",
    "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main",
}
CORE_FIELDS = ("dc:creator", "cp:lastModifiedBy", "cp:revision", "cp:category", "cp:contentStatus")
CORE_DATES = ("dcterms:created", "dcterms:modified")
APP_FIELDS = ("ep:Company", "ep:Manager", "ep:TotalTime", "ep:LastPrinted")


def expanded(name: str) -> str:
    prefix, _, local = name.partition(":")
    return f"{{{NAMESPACES[prefix]}}}{local}"


def rebuilt(root: ElementTree.Element) -> bytes:
    for prefix, uri in NAMESPACES.items():
        ElementTree.register_namespace(prefix, uri)
    return ElementTree.tostring(root, encoding="UTF-8", xml_declaration=True)


def without(root: ElementTree.Element, unwanted) -> list[str]:
    """Local names of the elements taken out."""
    gone = []
    for parent in root.iter():
        for child in [c for c in parent if isinstance(c.tag, str) and unwanted(c.tag)]:
            parent.remove(child)
            gone.append(child.tag.rpartition("}")[2])
    return gone


def scrub_part(name: str, payload: bytes, policy: Policy) -> tuple[bytes, list[Removal]]:
    """One part's new payload; what can't be parsed stays."""
    author = expanded("w:author")
    tracked = name.endswith(".xml") and name not in (CORE, APP, SETTINGS) and (b"w:author" in payload or author.encode() in payload)
    if tracked and not policy.strip_revisions:
        return payload, [Removal(name, "tracked-change authors", "reported only; use --strip-revisions to anonymise", False)]
    if not tracked and name not in (CORE, APP, SETTINGS):
        return payload, []
    try:
        root = safe_tree(payload)
    except Exception:
        return payload, []
    if tracked:
        named = [e for e in root.iter() if e.attrib.get(author, "Author") != "Author"]
        for element in named:
            element.set(author, "Author")
        return (rebuilt(root), [Removal(name, f"{len(named)} tracked-change author name(s)", "anonymised")]) if named else (payload, [])
    if name == SETTINGS:
        gone = without(root, lambda tag: tag.rpartition("}")[2].startswith("rsid") and "}" in tag)
        return (rebuilt(root), [Removal(SETTINGS, "w:rsid revision-session identifiers")]) if gone else (payload, [])
    fields = APP_FIELDS if name == APP else CORE_FIELDS + (CORE_DATES if policy.strip_dates else ())
    gone = without(root, {expanded(f) for f in fields}.__contains__)
    return (rebuilt(root), [Removal(name, g) for g in gone]) if gone else (payload, [])


def scrub_docx(data: bytes, policy: Policy) -> Scrubbed:
    out, buffer = Scrubbed(b""), io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as source, zipfile.ZipFile(buffer, "w") as target:
        for info in source.infolist():
            payload, found = scrub_part(info.filename, source.read(info), policy)
            out.removals += found
            if not info.filename.endswith(".xml"):
                out.preserved.append(info.filename)
            copy = zipfile.ZipInfo(info.filename, info.date_time)
            for kind in ("compress_type", "external_attr", "internal_attr", "create_system"):
                setattr(copy, kind, getattr(info, kind))
            target.writestr(copy, payload)
    out.data = buffer.getvalue() if out.changed else data
    return out
