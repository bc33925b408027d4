"""Inputs made from the driver's tables, alike in Spark and in SQL: noisy texts, file inventories, sources from templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What row i % 16 gets inserted after its first few characters, or in front where it begins with FRONT; case 15 gets nothing.
FRONT = "^"
INSERTS = [
    "​",
    "­",
    "⁠",
    "a‍b",
    "\U0001f468‍\U0001f469",
    "ی‌خ",
    "\U0001f468‍z",
    "‮evil‬",
    "\U0001f3f4\U000e0067\U000e0062\U000e0073\U000e0063\U000e0074\U000e007f",
    "x\U000e0041y",
    "\U0001f3f4\U000e0067z",
    "﻿",
    "^﻿",
    "\n​",
    "“q”—…",
    "",
]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def of_front(inserts: list[str]) -> tuple[list[str], list[str]]:
    """The inserts that go in front, and those that go into the text, each with nothing in the others' places."""
    return [x.removeprefix(FRONT) if x.startswith(FRONT) else "" for x in inserts], ["" if x.startswith(FRONT) else x for x in inserts]


def noisy(spark: SparkSession, sf_dir: str, inserts: list[str] = INSERTS) -> DataFrame:
    """doc_id, lang, text of every document, with noise that depends on the id."""
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    i, at = (F.col("doc_id") % len(inserts)).cast("int"), (F.col("doc_id") % 7).cast("int") + 1
    front, inner = (F.get(F.array(*map(F.lit, xs)), i) for xs in of_front(inserts))
    return docs.withColumn("text", F.concat(front, F.substring(F.col("text"), F.lit(1), at), inner, F.substring(F.col("text"), at + 1, F.char_length("text"))))


def noisy_sql(inserts: list[str] = INSERTS) -> str:
    front, inner = ("([" + ", ".join(f"'{x}'" for x in xs) + f"])[1 + (doc_id % {len(inserts)})::INT]" for xs in of_front(inserts))
    return f"noisy AS (SELECT doc_id, lang, {front} || substr(text, 1, 1 + (doc_id % 7)::INT) || {inner} || substr(text, 2 + (doc_id % 7)::INT) AS text FROM documents)"


#: Each rule's own noise, of which every document gets some.
OF_RULE = {
    "tag_sequences": ["\U0001f3f4\U000e0067\U000e0062\U000e0073\U000e0063\U000e0074\U000e007f", "x\U000e0041y", "\U0001f3f4\U000e0067z"],
    "joiners": ["a\u200db", "\U0001f468\u200d\U0001f469", "\u06cc\u200c\u062e", "\U0001f468\u200dz", "\U00011df0\u200dz"],
    "bom": ["\ufeff", FRONT + "\ufeff", FRONT + "\ufeff\ufeff"],
    "invisibles": ["\u200b", "\u00ad", "\u2060", "\n\u200b\u200e\u200f", "\u061c\u180e"],
    "bidi": ["\u202eevil\u202c", "\u2066x\u2069", "\u202a\u202b\u202d", "\u2067y\u2068"],
}

SUFFIXES = [".jpg", ".c2pa", ".tex", ".JPG", ".jpg.c2pa", ".txt", ".png", ".jpg", ".bib"]


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: base, path, dir, name, stem, suffix, ord. Names repeat, so destinations collide."""
    from ..functions import paths

    g = F.floor(F.col("doc_id") / 4).cast("long")
    ending = F.get(F.array(*map(F.lit, SUFFIXES)), ((F.col("doc_id") * F.col("doc_id") + F.floor(F.col("doc_id") / 3).cast("long")) % 9).cast("int"))
    rows = documents(spark, sf_dir).select(F.lit("in").alias("base"), F.concat(F.lit("in/d"), (g % 5).cast("string")).alias("dir"), F.concat(F.lit("f"), g.cast("string"), ending).alias("name"), F.col("doc_id").alias("ord"))
    return rows.select("base", F.concat("dir", F.lit("/"), "name").alias("path"), "dir", "name", paths.stem_of(F.col("name")).alias("stem"), paths.suffix_of(F.col("name")).alias("suffix"), "ord")


INVENTORY_SQL = (
    "named AS (SELECT 'in' AS base, 'in/d' || ((doc_id // 4) % 5) AS dir, 'f' || (doc_id // 4) || (["
    + ", ".join(f"'{x}'" for x in SUFFIXES)
    + "])[1 + ((doc_id * doc_id + doc_id // 3) % 9)::INT] AS name, doc_id AS ord FROM documents), "
    "files AS (SELECT base, dir || '/' || name AS path, dir, name, left(name, length(name) - length(regexp_extract(name, '[.][^.]*$'))) AS stem, regexp_extract(name, '[.][^.]*$') AS suffix, ord FROM named)"
)


def signer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, document: the JSON of a manifest store whose makers and certificates depend on the id."""
    i = F.col("doc_id")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    info = F.when(i % 5 == 0, "[]").when(i % 5 == 1, text('[{"name":"Claude","version":"', i % 3, '"}]')).when(i % 5 == 2, text('[{"name":"Maker ', i % 7, '"},{"name":"toolkit","version":"9"}]')).when(i % 5 == 3, text('[{"version":"', i, '"}]')).otherwise(text('[{"name":"Camera","version":""}]'))
    signature = F.when(i % 4 == 0, "{}").when(i % 4 == 1, text('{"issuer":"Anthropic ', i % 2, '","alg":"es256"}')).when(i % 4 == 2, text('{"issuer":"Org","common_name":"Claude ', i % 9, '","cert_serial_number":"', i, '"}')).otherwise('{"issuer":"Org","common_name":"Org"}')
    state = F.when(i % 3 == 0, ',"validation_state":"Valid"').when(i % 3 == 1, ',"validation_state":""').otherwise("")
    manifest = text('{"claim_generator_info":', info, ',"signature_info":', signature, F.when(i % 6 == 0, text(',"title":"t', i, '"')).otherwise(""), "}")
    return documents(spark, sf_dir).select("doc_id", text('{"active_manifest":"m', i % 2, '"', state, ',"manifests":{"m', F.when(i % 11 == 0, F.lit(7)).otherwise(i % 2), '":', manifest, "}}").alias("document"))


SIGNER_SQL = """given AS (SELECT doc_id,
  CASE doc_id % 5 WHEN 1 THEN 'Claude' WHEN 2 THEN 'Maker ' || (doc_id % 7) WHEN 4 THEN 'Camera' END AS maker, CASE doc_id % 5 WHEN 1 THEN (doc_id % 3)::VARCHAR WHEN 3 THEN doc_id::VARCHAR WHEN 4 THEN '' END AS version,
  CASE doc_id % 4 WHEN 1 THEN 'Anthropic ' || (doc_id % 2) WHEN 2 THEN 'Org' WHEN 3 THEN 'Org' END AS issuer, CASE doc_id % 4 WHEN 2 THEN 'Claude ' || (doc_id % 9) WHEN 3 THEN 'Org' END AS common_name,
  CASE doc_id % 4 WHEN 1 THEN 'es256' END AS alg, CASE doc_id % 4 WHEN 2 THEN doc_id::VARCHAR END AS cert_serial, CASE WHEN doc_id % 6 = 0 THEN 't' || doc_id END AS title, CASE WHEN doc_id % 3 = 0 THEN 'Valid' END AS validation_state, doc_id % 11 = 0 AS lost FROM documents),
signed AS (SELECT doc_id, CASE WHEN NOT lost THEN issuer END AS issuer, CASE WHEN NOT lost THEN common_name END AS common_name, CASE WHEN NOT lost THEN alg END AS alg, CASE WHEN NOT lost THEN cert_serial END AS cert_serial,
  CASE WHEN NOT lost THEN maker || CASE WHEN version <> '' THEN ' ' || version ELSE '' END END AS claim_generator, CASE WHEN NOT lost THEN title END AS title, validation_state FROM given),
signed2 AS (SELECT s.doc_id, s.issuer, s.common_name, s.alg, s.cert_serial, CASE WHEN g.lost THEN NULL WHEN g.maker IS NULL THEN NULL WHEN g.version IS NULL OR g.version = '' THEN g.maker ELSE g.maker || ' ' || g.version END AS claim_generator, s.title, s.validation_state FROM signed s JOIN given g USING (doc_id))"""


def pieces(*parts) -> F.Column:
    return F.concat(*(p if isinstance(p, F.Column) else F.lit(p) for p in parts))


TEX_PARTS = [
    # (text in the source, text once scrubbed): {i} is the row's id, {m} its id modulo 13
    ("\\documentclass{{article}}\r\n", None),
    ("% !TeX root = /home/u{m}/main{i}.tex\n", "% !TeX root = main{i}.tex\n"),
    ("% !TeX program = pdflatex\n", None),
    ("\\author{{Ann {{B}} {i}\\thanks{{Firm {m}}}}}\n", "\\author{{}}\n"),
    ("\\email{{a{i}@b.example}} % mail {m}\n", "\\email{{}} %\n"),
    ("\\date{{2024-0{m}}}\n", None),
    ("\\hypersetup{{pdftitle={{T {i}}},\n  pdfauthor={{Ann {i}}}, colorlinks=true}}\n", "\\hypersetup{{pdftitle={{T {i}}},\n   colorlinks=true}}\n"),
    ("\\pdfinfo{{/Title (x(y){i}) /Author (A (b) {i}) /Keywords (k)}}\n", "\\pdfinfo{{/Title (x(y){i})  }}\n"),
    ("Up {m}\\% and \\url{{a%20{i}}} and \\verb|%{m}| stay.\n", None),
    ("\\begin{{lstlisting}}\n# {i}% kept\n\\end{{lstlisting}}\n", None),
    ("\\includegraphics[w={m}]{{/home/u{i}.png}}\n", None),
    ("\\added[id=MP{m}]{{new}} text% cut {i}\n", "\\added[id=MP{m}]{{new}} text%\n"),
    ("%\n\\input{{sec{m}}}\n", None),
    ("\\begin{{comment}}\nhidden {i} % not cut\n\\end{{comment}}\n", None),
    ("\\iffalse gone {m}\\fi\n\\endinput\ntail {i}", None),
]


def tex_columns(kept: bool) -> F.Column:
    """The source (kept: scrubbed) of row doc_id as an expression; a row takes the parts whose number shares a bit with it or is even."""
    out = []
    for k, (source, clean) in enumerate(TEX_PARTS):
        text = clean if kept and clean is not None else source
        marks = text.replace("{{", "\x01").replace("}}", "\x02")
        bits = [b for piece in marks.split("{i}") for b in (piece, "{i}")][:-1]
        expr = []
        for bit in bits:
            if bit == "{i}":
                expr.append(F.col("doc_id").cast("string"))
            else:
                for j, sub in enumerate(bit.split("{m}")):
                    expr += [(F.col("doc_id") % 13).cast("string")] if j else []
                    expr.append(F.lit(sub.replace("\x01", "{").replace("\x02", "}")))
        out.append(F.when((F.col("doc_id") + k) % 3 != 1, F.concat(*expr)).otherwise(F.lit("")))
    return F.concat(*out)


def tex_sql(kept: bool) -> str:
    out = []
    for k, (source, clean) in enumerate(TEX_PARTS):
        text = (clean if kept and clean is not None else source).replace("{{", "\x01").replace("}}", "\x02").replace("'", "''")
        text = text.replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '").replace("{i}", "' || doc_id || '").replace("{m}", "' || (doc_id % 13) || '").replace("\x01", "{").replace("\x02", "}")
        out.append(f"CASE WHEN (doc_id + {k}) % 3 <> 1 THEN '{text}' ELSE '' END")
    return " || ".join(out)


def tex_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, suffix, content: a TeX source a document."""
    return documents(spark, sf_dir).select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".tex")).alias("path"), F.lit(".tex").alias("suffix"), F.encode(tex_columns(False), "UTF-8").alias("content"))


BIB_FIELDS = ["author = {{A and B}}", "file = {{/home/u{m}/x, {i}.pdf}}", 'note = "50% of {{a, b}} {i}"', "owner = {{u{m}}}", "timestamp = {{2024}}", "bdsk-file-{m} = {{Zz=}}", "url = {{h://a%20{i}}}", "pdf = {{p{i}}}"]
BIB_DROPPED = {1: "file", 3: "owner", 5: "bdsk-file-", 7: "pdf"}


def bib_text(sql: bool, kept: bool):
    """Entries of two to eight fields. The same text as an expression or as SQL."""
    parts = []
    for k, field in enumerate(BIB_FIELDS):
        text = "" if kept and k in BIB_DROPPED else field + ","
        text = "  " + text + "\n"
        parts.append((k, text.replace("{{", "{").replace("}}", "}") if "{i}" not in text and "{m}" not in text else text))
    head = "@article{{k{i},\n"
    if sql:
        fill = lambda t: "'" + t.replace("{{", "\x01").replace("}}", "\x02").replace("'", "''").replace("\n", "' || chr(10) || '").replace("{i}", "' || doc_id || '").replace("{m}", "' || (doc_id % 13) || '").replace("\x01", "{").replace("\x02", "}") + "'"
        return " || ".join([fill(head), *(f"CASE WHEN (doc_id + {k}) % 3 <> 0 THEN {fill(t)} ELSE '' END" for k, t in parts), "'}' || chr(10)"])

    def expr(t: str) -> F.Column:
        marks = t.replace("{{", "\x01").replace("}}", "\x02")
        out = []
        for j, piece in enumerate(marks.split("{i}")):
            out += [F.col("doc_id").cast("string")] if j else []
            for n, sub in enumerate(piece.split("{m}")):
                out += [(F.col("doc_id") % 13).cast("string")] if n else []
                out.append(F.lit(sub.replace("\x01", "{").replace("\x02", "}")))
        return F.concat(*out)

    return F.concat(expr(head), *(F.when((F.col("doc_id") + k) % 3 != 0, expr(t)).otherwise(F.lit("")) for k, t in parts), F.lit("}\n"))


def bib_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".bib")).alias("path"), F.lit(".bib").alias("suffix"), F.encode(bib_text(False, False), "UTF-8").alias("content"))
