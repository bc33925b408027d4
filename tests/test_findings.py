import random

from scrubjay.functions import chars
from scrubjay.functions.text import Options
from scrubjay.operators import findings

from .test_text import SPECIAL


def model(s, options):
    """(codepoint, line, column, action) of each decision, one character at a time."""
    ranges = chars.context_ranges()
    beside = lambda c: c is not None and any(a <= ord(c) <= b for a, b in ranges)
    out, i, line, col = [], 0, 1, 1
    while i < len(s):
        c, cp = s[i], ord(s[i])
        if c == "\n":
            line, col, i = line + 1, 1, i + 1
            continue
        if c == chars.FLAG:
            j = i + 1
            while j < len(s) and 0xE0020 <= ord(s[j]) <= 0xE007E:
                j += 1
            if j > i + 1 and j < len(s) and s[j] == chars.TAG_CANCEL:
                col, i = col + j + 1 - i, j + 1
                continue
        if 0xE0020 <= cp <= 0xE007F:
            out.append((cp, line, col, "removed"))
            i += 1
            continue
        if cp in chars.JOINER_NAMES:
            kept = beside(s[i - 1] if i else None) or beside(s[i + 1] if i + 1 < len(s) else None)
            out.append((cp, line, col, "kept" if kept else "removed"))
        elif cp == 0xFEFF:
            if i or options.strip_bom:
                out.append((cp, line, col, "removed"))
        elif cp in chars.INVISIBLE_NAMES:
            out.append((cp, line, col, "removed"))
        elif cp in chars.BIDI_NAMES:
            out.append((cp, line, col, "kept" if options.keep_bidi else "removed"))
        elif options.ascii_punct and cp in chars.TYPOGRAPHY:
            out.append((cp, line, col, "replaced"))
        col, i = col + 1, i + 1
    return out


def test_equals_the_model(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(SPECIAL) for _ in range(rng.randint(0, 16))) for _ in range(1500)]
    for options in (Options(), Options(keep_bidi=True, strip_bom=True, ascii_punct=True)):
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {}
        for r in findings.findings(rows, options=options).collect():
            got.setdefault(r.doc_id, []).append((r.pos, r.codepoint, r.line, r.column, r.action))
        for i, s in enumerate(texts):
            assert [g[1:] for g in sorted(got.get(i, []))] == model(s, options), repr(s)


def test_example_and_repeated_ids(spark):
    rows = spark.createDataFrame([(1, "ok\nbad\u200bhere"), (1, "\u200b"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted((r.line, r.column, r.name, r.pos) for r in findings.findings(rows).collect())
    assert got == [(1, 1, "ZERO WIDTH SPACE", 0), (2, 4, "ZERO WIDTH SPACE", 0)]
    shown = findings.findings(rows.where("text LIKE 'ok%'")).select(findings.rendered().alias("s")).first().s
    assert shown == "U+200B ZERO WIDTH SPACE — line 2, col 4: removed"
