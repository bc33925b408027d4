"""BibTeX: fields that reference managers add go, citations stay. A percent sign is no comment here."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from .base import Policy, Removal, Scrubbed, spliced

# Fields that are dropped.
DROPPED = frozenset("file local-url owner pdf".split())
DROPPED_PREFIX = "bdsk-file"
DATES = frozenset("timestamp date-added date-modified".split())

ENTRY = re.compile(rb"@[A-Za-z]+[ \t]*([{(])")
SYNTAX = re.compile(rb'\\[\s\S]?|["{}(),]')


def is_dropped(name: str, policy: Policy) -> bool:
    return name in DROPPED or name.startswith(DROPPED_PREFIX) or (policy.strip_dates and name in DATES)


def fields(data: bytes) -> Iterator[tuple[int, str, int, int]]:
    """(entry number, name, start, end with comma) of every field of every closed entry; entries inside an entry are its text."""
    at, number = 0, 0
    while (head := ENTRY.search(data, at)) is not None:
        opener = head[1]
        shutter = b"}" if opener == b"{" else b")"
        depth, quoted, commas, end = 1, False, [], None
        inner = 0  # open groups of the other kind of bracket, in which commas don't separate
        for token in SYNTAX.finditer(data, head.end()):
            t = token[0]
            if t == b'"' and depth == 1 and not inner:
                quoted = not quoted
            elif quoted:
                continue
            elif t == opener:
                depth += 1
            elif t == shutter:
                depth -= 1
                if depth == 0:
                    end = token.start()
                    break
            elif t in (b"{", b"("):
                inner += 1
            elif t in (b"}", b")"):
                inner = max(0, inner - 1)
            elif t == b"," and depth == 1 and not inner:
                commas.append(token.start())
        if end is None:
            at = head.end()
            continue
        start = head.end()
        for stop in [*commas, end]:
            first = start + len(data[start:stop]) - len(data[start:stop].lstrip(b" \t\r\n,"))
            name, equals, _ = data[first:stop].partition(b"=")
            if equals:
                yield number, name.strip().lower().decode("ascii", "replace"), first, min(stop + 1, end)
            start = stop + 1
        number, at = number + 1, end + 1


def scrub_bib(data: bytes, policy: Policy) -> Scrubbed:
    gone = [(name, start, end) for _, name, start, end in fields(data) if is_dropped(name, policy)]
    removals = [Removal("BibTeX entry", name, f"{n} occurrence(s)") for name, n in sorted(Counter(g[0] for g in gone).items())]
    return Scrubbed(spliced(data, [(start, end, b"") for _, start, end in gone]), removals)
