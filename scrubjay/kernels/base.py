"""What every format kernel takes and gives."""

from __future__ import annotations

from typing import NamedTuple


class Policy(NamedTuple):
    strip_dates: bool = False
    strip_revisions: bool = False


class Removal(NamedTuple):
    """Something found; applied is False where it is only reported."""

    where: str
    what: str
    detail: str = ""
    applied: bool = True


class Malformed(ValueError):
    """Bytes that are not of the format they claim."""


class Scrubbed:
    """New bytes, what was found, what was kept on purpose."""

    def __init__(self, data: bytes, removals: list[Removal] | None = None, preserved: list[str] | None = None):
        self.data, self.removals, self.preserved = data, removals or [], preserved or []

    @property
    def changed(self) -> bool:
        return any(r.applied for r in self.removals)


def spliced(data: bytes, edits: list[tuple[int, int, bytes]]) -> bytes:
    """data with each (start, end, replacement) made. Edits that overlap are an error."""
    pieces, at = [], 0
    for start, end, new in sorted(edits):
        if start < at:
            raise ValueError(f"overlapping edits at {start}")
        pieces += (data[at:start], new)
        at = end
    return b"".join([*pieces, data[at:]])
