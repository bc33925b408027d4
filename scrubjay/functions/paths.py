"""Names of files as column expressions. A path is dir/name; a name is stem and suffix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MANIFEST_SUFFIX = ".c2pa"
# Suffixes that a directory scan takes up.
MEDIA_SUFFIXES = (".jpg", ".jpeg", ".png", ".pdf", ".docx", MANIFEST_SUFFIX)
TEX_DIALECTS = {".tex": "latex", ".ltx": "latex", ".sty": "latex-package", ".cls": "latex-package", ".bib": "bibtex", ".dtx": "latex-docstrip", ".ins": "latex-docstrip"}
SUFFIXES = (*MEDIA_SUFFIXES, *TEX_DIALECTS)
MIME_TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".pdf": "application/pdf", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}


def suffix_of(name: Column) -> Column:
    """The last dot and what follows; empty for none, for a leading dot only, and for a dot at the end."""
    return F.regexp_extract(name, r"(?s)^.*[^/.](\.[^./]+)$", 1)


def stem_of(name: Column) -> Column:
    return F.left(name, F.char_length(name) - F.char_length(suffix_of(name)))


def is_supported(suffix: Column) -> Column:
    return F.lower(suffix).isin(*SUFFIXES)


def joined(folder: Column, name: Column) -> Column:
    return F.when((folder == "") | (folder == "."), name).otherwise(F.concat(folder, F.lit("/"), name))


def destination(base: Column, path: Column, folder: Column, name: Column, in_place: bool = False, output_dir: str | None = None) -> Column:
    """Where a cleaned file goes: itself, the mirrored place below output_dir, or <stem>.cleaned<suffix> beside it."""
    if in_place:
        return path
    if output_dir is not None:
        below = F.when(F.startswith(path, F.concat(base, F.lit("/"))), F.substring(path, F.char_length(base) + 2, F.char_length(path))).when((base == "") | (base == "."), path).otherwise(name)
        return F.concat(F.lit(output_dir.rstrip("/") + "/"), below)
    return joined(folder, F.concat(stem_of(name), F.lit(".cleaned"), suffix_of(name)))


def is_absolute(value: Column) -> Column:
    """Begins with / or ~, or with a drive and a slash."""
    return F.trim(value).rlike(r"(?s)^(?:[/~]|.:[\\/])")


def basename(value: Column) -> Column:
    plain = F.replace(F.trim(value), F.lit("\\"), F.lit("/"))
    last = F.substring_index(plain, "/", -1)
    return F.when(last == "", F.trim(value)).otherwise(last)


def mime_hint(name: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in MIME_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(suffix_of(name))), F.lit(""))
