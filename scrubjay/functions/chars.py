"""Characters that the text rules act on, and the patterns built from them."""

from __future__ import annotations

from functools import lru_cache

# Code points of each rule and their Unicode names.
ZWNJ, ZWJ, BOM = "‌", "‍", "﻿"
FLAG, TAG_FIRST, TAG_LAST, TAG_CANCEL = "\U0001f3f4", "\U000e0020", "\U000e007e", "\U000e007f"
JOINER_NAMES = {0x200C: "ZERO WIDTH NON-JOINER", 0x200D: "ZERO WIDTH JOINER"}
BOM_NAME = "ZERO WIDTH NO-BREAK SPACE"
INVISIBLE_NAMES = {
    0x00AD: "SOFT HYPHEN",
    0x061C: "ARABIC LETTER MARK",
    0x180E: "MONGOLIAN VOWEL SEPARATOR",
    0x200B: "ZERO WIDTH SPACE",
    0x200E: "LEFT-TO-RIGHT MARK",
    0x200F: "RIGHT-TO-LEFT MARK",
    0x2060: "WORD JOINER",
}
BIDI_NAMES = {
    0x202A: "LEFT-TO-RIGHT EMBEDDING",
    0x202B: "RIGHT-TO-LEFT EMBEDDING",
    0x202C: "POP DIRECTIONAL FORMATTING",
    0x202D: "LEFT-TO-RIGHT OVERRIDE",
    0x202E: "RIGHT-TO-LEFT OVERRIDE",
    0x2066: "LEFT-TO-RIGHT ISOLATE",
    0x2067: "RIGHT-TO-LEFT ISOLATE",
    0x2068: "FIRST STRONG ISOLATE",
    0x2069: "POP DIRECTIONAL ISOLATE",
}
TYPOGRAPHY = {
    0x00A0: (" ", "NO-BREAK SPACE"),
    0x2002: (" ", "EN SPACE"),
    0x2003: (" ", "EM SPACE"),
    0x2004: (" ", "THREE-PER-EM SPACE"),
    0x2005: (" ", "FOUR-PER-EM SPACE"),
    0x2006: (" ", "SIX-PER-EM SPACE"),
    0x2007: (" ", "FIGURE SPACE"),
    0x2008: (" ", "PUNCTUATION SPACE"),
    0x2009: (" ", "THIN SPACE"),
    0x202F: (" ", "NARROW NO-BREAK SPACE"),
    0x2013: ("-", "EN DASH"),
    0x2014: ("--", "EM DASH"),
    0x2015: ("--", "HORIZONTAL BAR"),
    0x2018: ("'", "LEFT SINGLE QUOTATION MARK"),
    0x2019: ("'", "RIGHT SINGLE QUOTATION MARK"),
    0x201A: ("'", "SINGLE LOW-9 QUOTATION MARK"),
    0x201B: ("'", "SINGLE HIGH-REVERSED-9 QUOTATION MARK"),
    0x201C: ('"', "LEFT DOUBLE QUOTATION MARK"),
    0x201D: ('"', "RIGHT DOUBLE QUOTATION MARK"),
    0x201E: ('"', "DOUBLE LOW-9 QUOTATION MARK"),
    0x201F: ('"', "DOUBLE HIGH-REVERSED-9 QUOTATION MARK"),
    0x2026: ("...", "HORIZONTAL ELLIPSIS"),
}
#: Scripts in which joiners choose letter forms.
JOINING_SCRIPTS = "Adlam Arabic Balinese Bengali Chakma Devanagari Gujarati Gurmukhi Javanese Kannada Khmer Malayalam Mandaic Mongolian Myanmar Nko Oriya Sinhala Syriac Tamil Telugu Thaana Tibetan Tirhuta".split()
#: Where Unicode 17.0, which the rules follow, differs from the properties of later versions: letters that only those assign
#: to the scripts above, and code points that were still reserved for pictographs.
AFTER_17 = [(0x0B53, 0x0B54), (0x10EC9, 0x10ECF), (0x10ED9, 0x10EEE), (0x10EF0, 0x10EF9), (0x11B0A, 0x11B0A), (0x11DF0, 0x11DF1)]
RESERVED_IN_17 = [(0x1F1AE, 0x1F1AE), (0x1F7DA, 0x1F7DB), (0x1F7F1, 0x1F7FF)]

NAMES = JOINER_NAMES | {0xFEFF: BOM_NAME} | INVISIBLE_NAMES | BIDI_NAMES | {cp: name for cp, (_, name) in TYPOGRAPHY.items()}


@lru_cache(maxsize=1)
def context_ranges() -> tuple[tuple[int, int], ...]:
    """Code point ranges beside which a joiner stays: the joining scripts and pictographs, by their properties in Unicode 17.0.

    The driver alone asks for them; executors get the finished pattern, whatever versions they have installed.
    """
    import regex

    members = "".join(rf"\p{{Script={s}}}" for s in JOINING_SCRIPTS) + r"\p{Extended_Pictographic}"
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    found = {ord(c) for c in regex.findall(f"[{members}]", everything)}
    found -= {p for a, b in AFTER_17 for p in range(a, b + 1)}
    found |= {p for a, b in RESERVED_IN_17 for p in range(a, b + 1)}
    starts = sorted(p for p in found if p - 1 not in found)
    return tuple(zip(starts, sorted(p for p in found if p + 1 not in found), strict=True))


def characters(points) -> str:
    return "".join(map(chr, sorted(points)))


@lru_cache(maxsize=1)
def context_class() -> str:
    """The ranges as members of a class, written as the characters themselves.

    Java's lookbehind sees characters beyond U+FFFF whole only when they are literal.
    """
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in context_ranges())


SEQUENCE = f"{FLAG}[{TAG_FIRST}-{TAG_LAST}]+{TAG_CANCEL}"
JOINERS = f"[{ZWNJ}{ZWJ}]"


def removal_pattern(keep_bidi: bool, strip_bom: bool) -> str:
    """Matches what goes, and, as group 1, emoji tag sequences that stay. The joiner comes before its lookbehind, so
    the engine looks behind only where there is one."""
    gone = f"{TAG_FIRST}-{TAG_CANCEL}" + characters(INVISIBLE_NAMES) + ("" if keep_bidi else characters(BIDI_NAMES))
    beside = context_class()
    parts = [f"({SEQUENCE})", f"[{gone}]", f"{JOINERS}(?<![{beside}]{JOINERS})(?![{beside}])", BOM if strip_bom else f"{BOM}(?<!\\A{BOM})"]
    return "|".join(parts)


def trigger_class(keep_bidi: bool = False) -> str:
    """A class that any text with something to remove has a member of."""
    return f"[{TAG_FIRST}-{TAG_CANCEL}{ZWNJ}{ZWJ}{BOM}{characters(INVISIBLE_NAMES)}{'' if keep_bidi else characters(BIDI_NAMES)}]"


def special_pattern(typography: bool) -> str:
    """Everything that a rule decides about: a whole tag sequence, or one character."""
    one = f"{TAG_FIRST}-{TAG_CANCEL}{ZWNJ}{ZWJ}{BOM}{characters(INVISIBLE_NAMES)}{characters(BIDI_NAMES)}" + (characters(TYPOGRAPHY) if typography else "")
    return f"{SEQUENCE}|[{one}]"
