"""TeX sources: a lexer for comments, verbatim regions and control words, and the scrubbers of its dialects.

Bytes are never decoded, so any ASCII-compatible encoding passes through. Differences from a literal reading of the common tools are
deliberate: optional arguments and starred forms of a macro are seen (\\author[short]{Name}, \\author*{Name}), \\input without braces
is listed, anonymising twice changes nothing, and all comment lines that open a package count as its header.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from typing import NamedTuple

from .base import Policy, Removal, Scrubbed, spliced

# What is copied as it stands, what is emptied, what is reported.
VERBATIM_ENVIRONMENTS = frozenset("verbatim verbatim* Verbatim Verbatim* BVerbatim LVerbatim lstlisting minted alltt comment filecontents filecontents*".split())
HIDDEN_ENVIRONMENTS = frozenset("comment filecontents filecontents*".split())
VERBATIM_INLINE = frozenset("verb verb* lstinline mintinline".split())
VERBATIM_ARGUMENT = frozenset("url nolinkurl path href".split())
IDENTITY = frozenset("author thanks email affiliation institute address authorrunning institution orcid correspondingauthor".split())
DATES = frozenset("date".split())
PATHS = frozenset("includegraphics input include bibliography addbibresource graphicspath lstinputlisting verbatiminput".split())
SOURCES = frozenset("input include".split())
REVISIONS = frozenset("added deleted replaced todo annote".split())
REVISION_KEYS = frozenset("id author caption".split())
HYPERSETUP_KEYS = frozenset("pdfauthor pdfcreator pdfproducer pdfsubject pdfkeywords".split())
PDFINFO_KEYS = frozenset("/Author /Creator /Producer /Subject /Keywords".split())
LICENCE_MARKERS = ("copyright", "(c)", "lppl", "latex project public license", "license", "licence", "all rights reserved", "gnu general public", "mit license", "permission is hereby granted", "this work may be distributed")
SYNTAX_AFTER_CATCODE = (b"\\%", b"`%", b"\\\\", b"`{", b"`}", b"\\{", b"\\}")
CATCODE_WINDOW = 32
SHOWN = 5

TOKEN = re.compile(rb"%[^\r\n]*|\\(?:([A-Za-z]+\*?)|[\s\S]?)")
INSIDE = re.compile(rb"\\[\s\S]?|%[^\r\n]*|[{}]")
OPTION = re.compile(rb"\\[\s\S]?|[\[\]]")
NESTING = re.compile(rb"\\[\s\S]?|[{}\[\]]|,")
BARE_FILE = re.compile(rb"[ \t]+([^\s{}\\%]+)")


class Span(NamedTuple):
    kind: str  # comment, opaque or control
    start: int
    end: int
    line: int
    name: str = ""


def closing(data: bytes, at: int, pairs: re.Pattern, opens: bytes, shuts: bytes) -> int | None:
    """Where the group that opens at `at` is closed, exclusive; tokens other than the two are skipped whole."""
    depth = 0
    for token in pairs.finditer(data, at):
        depth += (token[0] == opens) - (token[0] == shuts)
        if depth == 0 and token[0] == shuts:
            return token.end()
    return None


def blanks(data: bytes, at: int, kinds: bytes = b" \t") -> int:
    while at < len(data) and data[at] in kinds:
        at += 1
    return at


def argument(data: bytes, at: int) -> tuple[int, int] | None:
    """(start, end) of the brace group that follows, braces included; escapes and comments hide braces."""
    at = blanks(data, at, b" \t\r\n")
    end = closing(data, at, INSIDE, b"{", b"}") if data[at : at + 1] == b"{" else None
    return (at, end) if end else None


def option(data: bytes, at: int) -> tuple[int, int] | None:
    """(start, end) of the bracket group that follows, brackets included."""
    at = blanks(data, at)
    end = closing(data, at, OPTION, b"[", b"]") if data[at : at + 1] == b"[" else None
    return (at, end) if end else None


def after_options(data: bytes, at: int) -> int:
    while (found := option(data, at)) is not None:
        at = found[1]
    return at


def pairs_in(data: bytes, start: int, end: int) -> Iterator[tuple[str, int, int, int]]:
    """(key, start, end of value, end with comma) of comma-separated pairs."""
    at = start
    while (at := blanks(data, at, b" \t\r\n,")) < end:
        depth, stop = 0, end
        for token in NESTING.finditer(data, at, end):
            depth += (token[0] in b"{[") - (token[0] in b"}]")
            if token[0] == b"," and depth == 0:
                stop = token.start()
                break
        key = re.match(rb"[^= \t]*", data[at:stop])[0]
        yield key.decode("latin-1"), at, stop, min(end, stop + 1)
        at = stop + 1


def inline_end(data: bytes, at: int) -> int | None:
    """End of inline verbatim text whose delimiter is at `at`; it can't span lines."""
    mark = data[at : at + 1]
    if not mark or mark in b"\r\n*" or mark.isalpha():
        return None
    line_end = re.compile(rb"[\r\n]|\Z").search(data, at).start()
    found = data.find(b"}" if mark == b"{" else mark, at + 1, line_end)
    return None if found < 0 else found + 1


def opaque_end(data: bytes, word: str, at: int) -> tuple[int, str] | None:
    """(end, name) of the region that this control word opens, in which nothing is markup."""
    if word in VERBATIM_INLINE:
        start = at
        if data[at : at + 1] == b"[":
            depth = 0
            for m in re.finditer(rb"[\[\]]", data[at:]):
                depth += 1 if m[0] == b"[" else -1
                if depth == 0:
                    start = at + m.end()
                    break
        end = inline_end(data, start)
        return (end, word) if end else None
    if word in VERBATIM_ARGUMENT:
        start = blanks(data, at)
        end = closing(data, start, re.compile(rb"[{}]"), b"{", b"}") if data[start : start + 1] == b"{" else None
        return (end, word) if end else None
    if word == "begin" and (m := re.compile(rb"[ \t]*\{([^}]*)\}").match(data, at)) and (name := m[1].decode("latin-1")) in VERBATIM_ENVIRONMENTS:
        shut = b"\\end{" + m[1] + b"}"
        found = data.find(shut, m.end())
        return (len(data) if found < 0 else found + len(shut), name)
    return None


def spans(data: bytes) -> Iterator[Span]:
    """Comments, verbatim regions and control words in order."""
    at, line, counted = 0, 1, 0
    while (token := TOKEN.search(data, at)) is not None:
        start, at = token.span()
        line, counted = line + data.count(b"\n", counted, start), start
        if token[0][:1] == b"%":
            yield Span("comment", start, at, line)
        elif token[1] is not None:
            word = token[1].decode()
            if (region := opaque_end(data, word, at)) is not None:
                at = region[0]
                yield Span("opaque", start, at, line, region[1])
            else:
                yield Span("control", start, at, line, word)
        elif at == start + 1:
            return  # a lone backslash at the end


def is_absolute(value: bytes) -> bool:
    return re.match(rb"[/~]|.:[\\/]", value.strip(), re.S) is not None


def has_catcode_hazard(data: bytes) -> bool:
    """Whether the category of a syntax character is changed, so that this lexer's reading can't be trusted."""
    return any(mark in data[m.start() : m.start() + CATCODE_WINDOW] for m in re.finditer(rb"\\catcode", data) for mark in SYNTAX_AFTER_CATCODE)


def is_docstrip(data: bytes) -> bool:
    return re.search(rb"(?m)^%<[*/+-]", data[:65536]) is not None


def header_end(data: bytes) -> int:
    """End of the comment lines that open a file."""
    found = re.match(rb"(?:[ \t]*%[^\r\n]*(?:\r\n|\r|\n|\Z)|[ \t]*(?:\r\n|\r|\n))*", data)
    return found.end()


class Scrub:
    """One pass over one source."""

    def __init__(self, data: bytes, policy: Policy, dialect: str):
        self.data, self.policy, self.dialect = data, policy, dialect
        self.edits: list[tuple[int, int, bytes]] = []
        self.removals: list[Removal] = []
        self.preserved: list[str] = []
        self.cut_lines: list[int] = []
        self.sources: list[str] = []
        self.header = header_end(data) if dialect == "latex-package" else 0

    def note(self, where: str, what: str, detail: str = "", applied: bool = True) -> None:
        self.removals.append(Removal(where, what, detail, applied))

    def kept_comment(self, span: Span, body: bytes) -> str | None:
        """Why a comment is content in this dialect, or None."""
        if self.dialect == "latex-package":
            text = body.lower().decode("latin-1")
            return "licence header" if span.end <= self.header or any(m in text for m in LICENCE_MARKERS) else None
        if self.dialect == "latex-docstrip" and (span.start == 0 or self.data[span.start - 1] in b"\r\n"):
            return "docstrip guard" if body[:1] == b"<" else "docstrip documentation"
        return None

    def comment(self, span: Span) -> int:
        body = self.data[span.start + 1 : span.end]
        if why := self.kept_comment(span, body):
            self.preserved.append(f"{why} at line {span.line}")
        elif body.lstrip(b" \t")[:4].lower() == b"!tex":
            key, equals, value = body.partition(b"=")
            if equals and is_absolute(value):
                start = span.end - len(value.lstrip(b" \t"))
                plain = value.strip().replace(b"\\", b"/")
                self.edits.append((start, span.end, posixpath.basename(plain) or value.strip()))
                self.note(f"line {span.line}", "% !TeX directive path", "reduced to its basename")
        elif body:
            self.edits.append((span.start + 1, span.end, b""))
            self.cut_lines.append(span.line)
        return span.end

    def identity(self, span: Span, word: str) -> int:
        group = argument(self.data, after_options(self.data, span.end))
        short = option(self.data, span.end)
        if short and short[1] - short[0] > 2 and group:
            self.edits.append((short[0] + 1, short[1] - 1, b""))
            self.note(f"\\{word}", "optional value", f"line {span.line}")
        if not group:
            return span.end
        if group[1] - group[0] > 2:
            self.edits.append((group[0] + 1, group[1] - 1, b""))
            self.note(f"\\{word}", "value", f"line {span.line}")
        return group[1]

    def hypersetup(self, span: Span, word: str) -> int:
        group = argument(self.data, span.end)
        if not group:
            return span.end
        for key, start, _, end in pairs_in(self.data, group[0] + 1, group[1] - 1):
            if key.lower() in HYPERSETUP_KEYS:
                self.edits.append((start, end, b""))
                self.note("\\hypersetup", key, f"line {span.line}")
        return group[1]

    def pdfinfo(self, span: Span, word: str) -> int:
        group = argument(self.data, span.end)
        if not group:
            return span.end
        key = re.compile(rb"(/[A-Za-z0-9]*)[^(]*\(")
        at, last = group[0] + 1, group[1] - 1
        while (m := key.search(self.data, at, last)) is not None:
            end = closing(self.data, m.end() - 1, re.compile(rb"\\[\s\S]?|[()]"), b"(", b")")
            end = last if end is None or end > last else end
            if (name := m[1].decode()) in PDFINFO_KEYS:
                self.edits.append((m.start(), end, b""))
                self.note("\\pdfinfo", name, f"line {span.line}")
            at = end
        return group[1]

    def path(self, span: Span, word: str) -> int:
        start = after_options(self.data, span.end)
        group = argument(self.data, start)
        if group:
            value, end = self.data[group[0] + 1 : group[1] - 1], group[1]
        elif word in SOURCES and (bare := BARE_FILE.match(self.data, span.end)):
            value, end = bare[1], bare.end()
        else:
            return span.end
        if is_absolute(value.lstrip(b"{")):
            self.note(f"\\{word}", "absolute path", f"line {span.line}; reported only, rewriting it would break the build", False)
        if word in SOURCES and value.strip():
            self.sources.append(value.strip().decode("ascii", "replace"))
        return end

    def revision(self, span: Span, word: str) -> int:
        group = option(self.data, span.end)
        if not group:
            return span.end
        if not self.policy.strip_revisions:
            self.note(f"\\{word}", "revision author", f"line {span.line}; reported only, use --strip-revisions", False)
            return group[1]
        before = len(self.edits)
        for key, start, end, _ in pairs_in(self.data, group[0] + 1, group[1] - 1):
            equals = self.data.find(b"=", start, end)
            if key.lower() in REVISION_KEYS and equals >= 0:
                stop = equals + 1 + len(self.data[equals + 1 : end].rstrip(b" ,"))
                if self.data[equals + 1 : stop] != b"Author":
                    self.edits.append((equals + 1, stop, b"Author"))
        if len(self.edits) > before:
            self.note(f"\\{word}", "revision author", f"line {span.line}; anonymised")
        return group[1]

    def control(self, span: Span) -> int:
        word = span.name.removesuffix("*")
        if word in IDENTITY or (word in DATES and self.policy.strip_dates):
            return self.identity(span, word)
        if word in ("hypersetup", "pdfinfo"):
            return getattr(self, word)(span, word)
        if word in PATHS:
            return self.path(span, word)
        if word in REVISIONS:
            return self.revision(span, word)
        rest = len(self.data) - span.end
        if word == "endinput" and rest > 1:
            self.note(f"line {span.line}", "content after \\endinput", f"{rest} bytes hidden from the rendered document", False)
        if word == "iffalse" and (shut := self.data.find(b"\\fi", span.end)) >= 0:
            self.note(f"line {span.line}", "\\iffalse block", f"{shut - span.end} bytes hidden from the rendered document", False)
        return span.end

    def run(self) -> Scrubbed:
        handled = 0
        for span in spans(self.data):
            if span.start < handled:
                continue
            if span.kind == "opaque":
                self.preserved.append(f"verbatim {span.name} at line {span.line}")
                if span.name in HIDDEN_ENVIRONMENTS:
                    self.note(f"line {span.line}", f"{span.name} environment", f"{span.end - span.start} bytes hidden from the rendered document", False)
            else:
                handled = self.comment(span) if span.kind == "comment" else self.control(span)
        listed = lambda items: ", ".join(map(str, items[:SHOWN])) + (", ..." if len(items) > SHOWN else "")
        if self.sources:
            self.note("LaTeX source", f"references {len(self.sources)} other source file(s)", f"{listed(self.sources)}; scrub the project directory to cover them", False)
        if self.cut_lines:
            self.note("LaTeX comments", f"{len(self.cut_lines)} comment body(s) truncated", f"lines {listed(self.cut_lines)}")
        return Scrubbed(spliced(self.data, self.edits), self.removals, self.preserved)


def scrub_tex(data: bytes, policy: Policy, dialect: str = "latex") -> Scrubbed:
    if dialect == "latex-docstrip" and not is_docstrip(data):
        return Scrubbed(data, [Removal("docstrip source", "no %<...> guards found", "reported only; cannot distinguish documentation from comments", False)])
    if has_catcode_hazard(data):
        return Scrubbed(data, [Removal("LaTeX source", "\\catcode applied to a syntax character", "reported only; the scanner's assumptions no longer hold", False)])
    return Scrub(data, policy, dialect).run()
