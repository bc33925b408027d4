"""Text hygiene as column expressions. All rules look at the raw text, so one replacement makes them all."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import chars


class Options(NamedTuple):
    keep_bidi: bool = False
    ascii_punct: bool = False
    normalize: str | None = None  # nfc, nfd, nfkc or nfkd
    strip_bom: bool = False
    #: Repeat until nothing changes: two removable marks lie inside joining scripts, so one pass may leave a joiner alone.
    settle: bool = False


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_punctuation(text: Column) -> Column:
    """Typographic quotes, dashes, ellipses and spaces as ASCII. The text is bound first: it stands in several places, and may be costly."""
    single = {cp: to for cp, (to, _) in chars.TYPOGRAPHY.items() if len(to) == 1}

    def ascii_of(t: Column) -> Column:
        out = F.translate(t, "".join(map(chr, single)), "".join(single.values()))
        for cp, (to, _) in chars.TYPOGRAPHY.items():
            if len(to) > 1:
                out = F.replace(out, F.lit(chr(cp)), F.lit(to))
        return F.when(t.rlike(f"[{chars.characters(chars.TYPOGRAPHY)}]"), out).otherwise(t)

    return bound(text, ascii_of)


def removed(text: Column, options: Options) -> Column:
    once = lambda t: F.when(t.rlike(chars.trigger_class(options.keep_bidi)), F.regexp_replace(t, chars.removal_pattern(options.keep_bidi, options.strip_bom), "$1")).otherwise(t)
    return bound(once(text), once) if options.settle else once(text)


#: The normal forms as static methods of the ICU library, which Spark brings along for its collations.
FORMS = {"NFC": ("compose", False), "NFD": ("decompose", False), "NFKC": ("compose", True), "NFKD": ("decompose", True)}


def normal_form(text: Column, form: str) -> Column:
    """A Unicode normal form, without Python. Spark has no such function, and calls others without knowing that they are pure: in a join's
    condition or inside an aggregate function, give it a column of its own first."""
    if form.upper() not in FORMS:
        raise ValueError(f"no normal form: {form}")
    method, compatible = FORMS[form.upper()]
    out = F.try_reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), text, F.lit(compatible))
    # Null where the library fails, as it does for null only; the text is looked at again in that case alone.
    return F.coalesce(out, F.when(text.isNotNull(), F.raise_error(F.lit(f"no {form} of a text")).cast("string")))


def clean(text: Column | str, options: Options = Options()) -> Column:
    """The cleaned text; null stays null."""
    text = F.col(text) if isinstance(text, str) else text
    out = removed(text, options)
    out = ascii_punctuation(out) if options.ascii_punct else out
    return normal_form(out, options.normalize) if options.normalize else out


def changed(before: Column, after: Column) -> Column:
    """Whether cleaning made a difference, normal forms included."""
    return ~before.eqNullSafe(after)


def decoded(content: Column, encoding: str = "utf-8") -> Column:
    """Strictly decoded text, or null where the bytes are not in the encoding."""
    if encoding.lower().replace("-", "") in ("utf8",):
        return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    return F.try_validate_utf8(F.decode(content, encoding))
