"""Which format a file is, from its first bytes; the suffix only picks a TeX dialect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.paths import TEX_DIALECTS

# Signatures, windows and markers.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
DOCX_WINDOW, BINARY_WINDOW, TEX_WINDOW = 4096, 8192, 65536
STRONG_MARKERS = (r"\documentclass", r"\documentstyle", r"\begin{document}", r"\ProvidesPackage", r"\ProvidesClass", r"\NeedsTeXFormat")
WEAK_MARKERS = (*STRONG_MARKERS, r"\usepackage", r"\RequirePackage", r"\newcommand", r"\renewcommand", r"\begin{")
BIB_ENTRY = r"@[A-Za-z]+[ \t\n\r\f\x0B]*[{(]"
GUARD = r"(?m)^%<[*/+-]"


def begins(content: Column, signature: bytes) -> Column:
    return F.substring(content, 1, len(signature)) == F.lit(signature)


def holds(content: Column, needle: bytes, window: int) -> Column:
    return F.position(F.lit(needle), F.substring(content, 1, window)) > 0


def is_jpeg(content: Column) -> Column:
    return begins(content, b"\xff\xd8")


def is_png(content: Column) -> Column:
    return begins(content, PNG_SIGNATURE)


def is_pdf(content: Column) -> Column:
    return begins(content, b"%PDF-")


def is_docx(content: Column) -> Column:
    return begins(content, b"PK") & holds(content, b"[Content_Types].xml", DOCX_WINDOW)


def is_binary(content: Column) -> Column:
    """UTF-16, or a zero byte near the start."""
    return begins(content, b"\xff\xfe") | begins(content, b"\xfe\xff") | holds(content, b"\x00", BINARY_WINDOW)


def head(content: Column) -> Column:
    return F.decode(F.substring(content, 1, TEX_WINDOW), "ISO-8859-1")


def looks_like_latex(content: Column, strong: bool = False) -> Column:
    text = head(content)
    hits = [F.contains(text, F.lit(m)) for m in (STRONG_MARKERS if strong else WEAK_MARKERS)]
    out = hits[0]
    for hit in hits[1:]:
        out = out | hit
    return ~is_binary(content) & out


def looks_like_bib(content: Column) -> Column:
    return ~is_binary(content) & head(content).rlike(BIB_ENTRY)


def looks_like_docstrip(content: Column) -> Column:
    return ~is_binary(content) & F.concat(F.lit("\n"), head(content)).rlike(r"\n%<[*/+-]")


def tex_family(content: Column, suffix: Column) -> Column:
    """The TeX dialect: by suffix where that is known, else by content; null if it is none."""
    known = F.try_element_at(F.create_map(*(F.lit(x) for pair in TEX_DIALECTS.items() for x in pair)), F.lower(suffix))
    by_content = F.when(looks_like_docstrip(content), "latex-docstrip").when(looks_like_bib(content) & ~looks_like_latex(content, True), "bibtex").when(looks_like_latex(content, True), "latex")
    return F.when(~is_binary(content), F.coalesce(known, by_content))


def format_of(content: Column, suffix: Column) -> Column:
    """jpeg, png, pdf, docx, a TeX dialect, or null."""
    return F.when(is_jpeg(content), "jpeg").when(is_png(content), "png").when(is_pdf(content), "pdf").when(is_docx(content), "docx").otherwise(tex_family(content, suffix))
