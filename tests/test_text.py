import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scrubjay.functions import chars, text
from scrubjay.functions.text import Options

ENGLAND = "\U0001f3f4\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f"
FAMILY = "\U0001f468\u200d\U0001f469\u200d\U0001f467"


def model(s, options=Options()):
    """The rules read one character at a time."""
    ranges = chars.context_ranges()
    beside = lambda c: c is not None and any(a <= ord(c) <= b for a, b in ranges)
    out, i = [], 0
    while i < len(s):
        c = s[i]
        if c == chars.FLAG:
            j = i + 1
            while j < len(s) and 0xE0020 <= ord(s[j]) <= 0xE007E:
                j += 1
            if j > i + 1 and j < len(s) and s[j] == chars.TAG_CANCEL:
                out.append(s[i : j + 1])
                i = j + 1
                continue
        cp = ord(c)
        if 0xE0020 <= cp <= 0xE007F or cp in chars.INVISIBLE_NAMES or (cp in chars.BIDI_NAMES and not options.keep_bidi):
            pass
        elif cp in chars.JOINER_NAMES:
            if beside(s[i - 1] if i else None) or beside(s[i + 1] if i + 1 < len(s) else None):
                out.append(c)
        elif cp == 0xFEFF:
            if i == 0 and not options.strip_bom:
                out.append(c)
        elif options.ascii_punct and cp in chars.TYPOGRAPHY:
            out.append(chars.TYPOGRAPHY[cp][0])
        else:
            out.append(c)
        i += 1
    return "".join(out)


def cleaned(spark, texts, options=Options()):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    return [r.clean for r in rows.select("i", text.clean("text", options).alias("clean")).orderBy("i").collect()]


@pytest.mark.parametrize("s", [FAMILY, ENGLAND, "می\u200cخواهم", "क्\u200dष", "க்\u200cஷ", "", "plain"])
def test_meaningful_sequences_stay(spark, s):
    assert cleaned(spark, [s]) == [s]


CASES = [
    ("he\u200bllo", Options(), "hello"),
    ("soft\u00adhyphen", Options(), "softhyphen"),
    ("mid\ufefftext", Options(), "midtext"),
    ("ab\u200dcd", Options(), "abcd"),
    ("hi\U000e0041there", Options(), "hithere"),
    ("\ufeffhello", Options(), "\ufeffhello"),
    ("\ufeffhello", Options(strip_bom=True), "hello"),
    ("x = \u202eevil\u202c", Options(), "x = evil"),
    ("x = \u202eevil\u202c", Options(keep_bidi=True), "x = \u202eevil\u202c"),
    ("it\u2019s \u201cfine\u201d \u2014 really\u2026", Options(), "it\u2019s \u201cfine\u201d \u2014 really\u2026"),
    ("it\u2019s \u201cfine\u201d \u2014 really\u2026", Options(ascii_punct=True), "it's \"fine\" -- really..."),
    ("e\u0301", Options(normalize="nfc"), "é"),
    ("ﬁ é", Options(normalize="nfkd"), unicodedata.normalize("NFKD", "ﬁ é")),
    ("a\u200d\u061cb", Options(), "a\u200db"),
    ("a\u200d\u061cb", Options(settle=True), "ab"),
    (None, Options(), None),
]


def test_single_cases(spark):
    for s, options, want in CASES:
        assert cleaned(spark, [s], options) == [want], (s, options)


SPECIAL = [chars.FLAG, *map(chr, [0xE0020, 0xE0041, 0xE007E, 0xE007F, 0x200C, 0x200D, 0xFEFF, 0x200B, 0xAD, 0x61C, 0x180E, 0x202E, 0x2066, 0x2014, 0x2026, 0x201C, 0x1F468, 0x1F469, 0x6CC, 0x62E, 0x915, 0x94D, 0xA9]), "a", "b", " ", "\n", "é"]


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from(SPECIAL), max_size=14), min_size=60, max_size=120), st.booleans(), st.booleans(), st.booleans())
def test_equals_the_model(spark, texts, keep_bidi, strip_bom, ascii_punct):
    options = Options(keep_bidi=keep_bidi, strip_bom=strip_bom, ascii_punct=ascii_punct)
    got = cleaned(spark, texts, options)
    assert got == [model(s, options) for s in texts]
    if not ascii_punct:
        assert all(len(a) <= len(b) for a, b in zip(got, texts))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from(SPECIAL), max_size=12), min_size=40, max_size=80))
def test_settled_text_is_stable(spark, texts):
    once = cleaned(spark, texts, Options(settle=True))
    assert cleaned(spark, once, Options(settle=True)) == once


def test_strict_decoding(spark):
    rows = spark.createDataFrame([(0, b"ok \xc3\xa9"), (1, b"bad \xff"), (2, None), (3, b"")], "i long, b binary").select("i", text.decoded(F.col("b")).alias("t"))
    assert [r.t for r in rows.orderBy("i").collect()] == ["ok é", None, None, ""]


def test_clean_stays_in_one_stage(spark, sf_dir):
    from scrubjay.plans import recipes

    plan = recipes.noisy(spark, sf_dir).select(text.clean("text"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_normal_forms_need_no_python(spark):
    """A worker would hold whole batches of texts in Python strings, several times over."""
    texts = ["\u1112\u1161\u11ab \u212b e\u0301\u0327", "\ufb01\U0001d15e\u0344\u00bd", "", "plain", "\u0958\x00\u0f73 " * 2000, None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for form in ("nfc", "nfd", "nfkc", "nfkd"):
        done = rows.select("t", text.clean("t", Options(normalize=form)).alias("x"))
        assert "Python" not in done._jdf.queryExecution().executedPlan().toString()
        assert all(r.x == (None if r.t is None else unicodedata.normalize(form.upper(), r.t)) for r in done.collect())
    grouped = spark.createDataFrame([("\u00e9",), ("e\u0301",), (None,)], "t string").groupBy(text.clean("t", Options(normalize="nfc")).alias("x")).count()
    assert {r.x: r["count"] for r in grouped.collect()} == {"\u00e9": 2, None: 1}
