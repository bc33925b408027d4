"""Registered queries, each with the SQL that tells its result where SQL can."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, provenance
from ..functions import text as rules
from ..functions.text import Options
from ..kernels.base import Policy
from ..operators import findings, gate, ranges, report, sniff
from ..operators.scrub import REMOVALS, scrub_rows, scrubbed
from ..session import scratch
from ..sources import files, units
from . import oracles, recipes, run, samples

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name or query.__name__] = query
        if sql:
            SQL[name or query.__name__] = sql
        return query

    return add


# Text rules


def cleaning(name: str, options: Options, inserts: list[str] = recipes.INSERTS, **sql: bool) -> None:
    """A query that cleans every text, with noise of all kinds or of one rule's."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return recipes.noisy(spark, sf_dir, inserts).select("doc_id", rules.clean("text", options).alias("clean"))

    registered(oracles.text_sql(inserts=inserts, **sql), name)(query)


cleaning("t_scrub_default", Options())
for rule, noise in recipes.OF_RULE.items():
    cleaning(f"t_{rule}", Options(), noise)
cleaning("t_strip_bom", Options(strip_bom=True), strip_bom=True)
cleaning("t_keep_bidi", Options(keep_bidi=True), keep_bidi=True)
cleaning("t_ascii_punct", Options(ascii_punct=True), ascii_punct=True)
COMBINING = "e" + chr(0x301) + "A" + chr(0x30A)


@registered(oracles.cleaned_sql() + f" SELECT doc_id, nfc_normalize(clean || '{COMBINING}') AS clean FROM cleaned")
def t_nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recipes.noisy(spark, sf_dir)
    return rows.select("doc_id", rules.clean(F.concat("text", F.lit(COMBINING)), Options(normalize="nfc")).alias("clean"))


#: What the other forms change: ligatures, squared and wide forms, composed letters and syllables.
COMPATIBLE = "\ufb01\u33a7\uff21\u00e9\u212b\uac00\u00bd"


@registered()
def t_other_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NFD, NFKC and NFKD, which DuckDB lacks; a test compares with Python's own."""
    rows = recipes.noisy(spark, sf_dir).select("doc_id", F.concat("text", F.lit(COMPATIBLE)).alias("text"))
    cleaned = rows.select("doc_id", rules.clean("text").alias("clean"))
    return cleaned.select("doc_id", *(rules.normal_form(F.col("clean"), f).alias(f) for f in ("nfd", "nfkc", "nfkd")))


@registered(oracles.cleaned_sql() + " SELECT lang, count(*) AS documents, count(*) FILTER (text <> clean) AS changed, sum(length(text) - length(clean))::BIGINT AS removed FROM cleaned GROUP BY lang")
def t_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: documents, changed ones, code points removed."""
    rows = recipes.noisy(spark, sf_dir).withColumn("clean", rules.clean("text"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.count_if(rules.changed(F.col("text"), F.col("clean"))).alias("changed"), F.sum(F.char_length("text") - F.char_length("clean")).cast("long").alias("removed"))


@registered("SELECT doc_id, decode(encode(text)) AS text, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END AS valid FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, NULL, 0 FROM documents WHERE doc_id % 4 = 0")
def t_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict decoding: every fourth text gets a byte that UTF-8 never has."""
    bad = F.when(F.col("doc_id") % 4 == 0, F.lit(b"\xff")).otherwise(F.lit(b""))
    rows = recipes.documents(spark, sf_dir).select("doc_id", F.concat(F.encode("text", "UTF-8"), bad).alias("content"))
    text = rules.decoded(F.col("content"))
    return rows.select("doc_id", text.alias("text"), F.when(text.isNull(), 0).otherwise(1).alias("valid"))


# Findings


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.findings(recipes.noisy(spark, sf_dir))


@registered(oracles.findings_sql() + ' SELECT doc_id, pos, codepoint, name, line, "column", action, reason FROM found')
def f_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir)


@registered(oracles.findings_sql() + " SELECT codepoint, name, count(*) AS n FROM found GROUP BY codepoint, name")
def f_by_codepoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).groupBy("codepoint", "name").agg(F.count(F.lit(1)).alias("n"))


@registered(oracles.findings_sql() + " SELECT lang, action, count(*) AS n FROM found GROUP BY lang, action")
def f_by_action_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recipes.noisy(spark, sf_dir).select(F.struct("doc_id", "lang").alias("row"), "text")
    return findings.findings(rows, "row").groupBy(F.col("row.lang").alias("lang"), "action").agg(F.count(F.lit(1)).alias("n"))


@registered(oracles.findings_sql() + f" SELECT doc_id, pos, {oracles.RENDERED} AS shown FROM found")
def f_report_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).select("doc_id", "pos", findings.rendered().alias("shown"))


@registered(oracles.findings_sql() + f", lined AS (SELECT doc_id, pos, action, {oracles.RENDERED} AS shown FROM found) SELECT doc_id, count(*) AS changes, array_to_string(list(shown ORDER BY pos), chr(10)) AS lines FROM lined WHERE action <> 'kept' GROUP BY doc_id")
def f_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.listing(found(spark, sf_dir)).withColumn("lines", F.array_join("lines", "\n"))


@registered(oracles.findings_sql() + " SELECT doc_id, lang FROM noisy WHERE doc_id IN (SELECT doc_id FROM found)")
def f_documents_with_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.noisy(spark, sf_dir).select("doc_id", "lang").join(found(spark, sf_dir), "doc_id", "left_semi")


@registered(oracles.findings_sql() + " SELECT doc_id, lang FROM noisy WHERE doc_id NOT IN (SELECT doc_id FROM found)")
def f_clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.noisy(spark, sf_dir).select("doc_id", "lang").join(found(spark, sf_dir), "doc_id", "left_anti")


@registered(
    f"WITH {recipes.noisy_sql()}, {oracles.ranges_sql()}, letters AS (SELECT unicode(letter) AS codepoint, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS letter FROM noisy) GROUP BY letter) "
    "SELECT codepoint, n FROM letters WHERE EXISTS (SELECT 1 FROM ranges r WHERE codepoint BETWEEN r.lo AND r.hi)"
)
def t_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code points of the texts that lie in a joining script or are pictographs."""
    points = recipes.noisy(spark, sf_dir).select(F.explode(F.split("text", "")).alias("ch")).groupBy(F.ascii("ch").alias("codepoint")).agg(F.count(F.lit(1)).alias("n"))
    return ranges.members(points, ranges.context_table(spark))


@registered(
    "WITH r AS (SELECT source AS key, (doc_id * 7) % 1009 AS lo, (doc_id * 7) % 1009 + doc_id % 5 AS hi FROM documents), s AS (SELECT *, coalesce(lo > max(hi) OVER (PARTITION BY key ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, true)::INT AS b FROM r), "
    "i AS (SELECT *, sum(b) OVER (PARTITION BY key ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM s) SELECT key, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY key, island"
)
def t_merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo = F.col("doc_id") * 7 % 1009
    return ranges.merged(recipes.documents(spark, sf_dir).select(F.col("source").alias("key"), lo.alias("lo"), (lo + F.col("doc_id") % 5).alias("hi")))


# Inventories and the provenance gate


@registered(f"WITH {recipes.INVENTORY_SQL} SELECT base, path, dir, name, stem, suffix, ord FROM files")
def c_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.inventory(spark, sf_dir)


@registered(f"WITH {recipes.INVENTORY_SQL} SELECT path, lower(suffix) AS suffix, CASE lower(suffix) WHEN '.jpg' THEN 'image/jpeg' WHEN '.png' THEN 'image/png' ELSE '' END AS mime FROM files WHERE lower(suffix) <> '.txt'")
def c_suffix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recipes.inventory(spark, sf_dir).where(paths.is_supported(F.col("suffix")))
    return rows.select("path", F.lower("suffix").alias("suffix"), paths.mime_hint(F.col("name")).alias("mime"))


@registered(f"WITH {recipes.INVENTORY_SQL} SELECT ord, dir || '/' || stem || '.cleaned' || suffix AS beside, path AS in_place, 'out/' || substr(path, 4) AS mirrored FROM files")
def c_destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = lambda **k: paths.destination(F.col("base"), F.col("path"), F.col("dir"), F.col("name"), **k)
    return recipes.inventory(spark, sf_dir).select("ord", where().alias("beside"), where(in_place=True).alias("in_place"), where(output_dir="out/").alias("mirrored"))


@registered(f"WITH {recipes.INVENTORY_SQL}, ranked AS (SELECT ord, path, dir || '/' || stem || '.cleaned' || suffix AS destination, first_value(path) OVER w AS first, row_number() OVER w AS rn FROM files WINDOW w AS (PARTITION BY dir || '/' || stem || '.cleaned' || suffix ORDER BY ord)) SELECT ord, path, 'destination ' || destination || ' is already claimed by ' || first AS error FROM ranked WHERE rn > 1")
def c_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gate.claimed(gate.with_destination(recipes.inventory(spark, sf_dir)))
    return rows.select("ord", "path", gate.collision_error(F.col("destination"), F.col("claimed_by")).alias("error")).where("error IS NOT NULL")


@registered(oracles.GATE_SQL + " SELECT path, array_to_string(sidecars, ';') AS sidecars FROM sides")
def c_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.sidecars(recipes.inventory(spark, sf_dir)).withColumn("sidecars", F.array_join("sidecars", ";"))


@registered(oracles.GATE_SQL + " SELECT path, array_to_string(manifest_assets, ';') AS manifest_assets FROM belongs")
def c_sidecar_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.sidecar_assets(recipes.inventory(spark, sf_dir)).withColumn("manifest_assets", F.array_join("manifest_assets", ";"))


@registered(oracles.GATE_SQL + " SELECT ord, path FROM files WHERE lower(suffix) = '.c2pa' AND path NOT IN (SELECT path FROM belongs)")
def c_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.orphans(recipes.inventory(spark, sf_dir)).select("ord", "path")


@registered(oracles.GATE_SQL + " SELECT ord, path FROM files WHERE lower(suffix) <> '.c2pa' AND path NOT IN (SELECT path FROM sides)")
def c_unmatched_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.unmatched_assets(recipes.inventory(spark, sf_dir)).select("ord", "path")


@registered(oracles.GATE_SQL + " SELECT ord, path, disposition, provenance, disposition <> 'scrub_freely' AS refused FROM disposed")
def c_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gate.provenance_of(recipes.inventory(spark, sf_dir)).withColumn("disposition", provenance.disposition(F.col("prov")))
    return rows.select("ord", "path", "disposition", provenance.describe(F.col("prov")).alias("provenance"), provenance.refused(F.col("disposition"), F.lit(None)).alias("refused"))


LADDER = {"embedded": "doc_id % 2 = 1", "sidecar": "doc_id % 3 = 1", "remote": "doc_id % 5 = 1", "unrecognized": "doc_id % 7 = 1", "is_manifest": "doc_id % 11 = 1"}


@registered(
    "SELECT doc_id, CASE WHEN NOT (doc_id % 2 = 1 OR doc_id % 3 = 1 OR doc_id % 5 = 1 OR doc_id % 7 = 1 OR doc_id % 11 = 1) THEN 'scrub_freely' WHEN doc_id % 11 = 1 THEN 'refuse_is_manifest' WHEN doc_id % 7 = 1 THEN 'refuse_unrecognized' ELSE 'refuse' END AS plain, "
    "CASE WHEN NOT (doc_id % 2 = 1 OR doc_id % 3 = 1 OR doc_id % 5 = 1 OR doc_id % 7 = 1 OR doc_id % 11 = 1) THEN 'scrub_freely' WHEN doc_id % 11 = 1 THEN 'refuse_is_manifest' WHEN doc_id % 7 = 1 THEN 'refuse_unrecognized' ELSE 'refuse_needs_cert' END AS resealing FROM documents"
)
def c_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision ladder over every mix of indicators."""
    none = F.lit(None).cast("string")
    flag = {k: F.expr(v) for k, v in LADDER.items()}
    p = F.struct(flag["embedded"].alias("embedded"), F.when(flag["sidecar"], F.array(F.lit("a.c2pa"))).otherwise(F.array().cast("array<string>")).alias("sidecars"), F.when(flag["remote"], "u").otherwise(none).alias("remote_url"), F.when(flag["unrecognized"], "x").otherwise(none).alias("unrecognized"), flag["is_manifest"].alias("is_manifest"), F.array().cast("array<string>").alias("manifest_assets"), F.lit(None).cast(provenance.SIGNER).alias("signer"))
    rows = recipes.documents(spark, sf_dir).select("doc_id", p.alias("p"))
    return rows.select("doc_id", provenance.disposition(F.col("p")).alias("plain"), provenance.disposition(F.col("p"), reseal=True).alias("resealing"))


@registered(f"WITH {recipes.SIGNER_SQL} SELECT * FROM signed2")
def c_signer_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recipes.signer_documents(spark, sf_dir).withColumn("s", provenance.signer_of(F.col("document")))
    return rows.select("doc_id", *(F.col("s")[c].alias(c) for c in ("issuer", "common_name", "alg", "cert_serial", "claim_generator", "title", "validation_state")))


ATTRIBUTION_SQL = "CASE WHEN lower(coalesce(claim_generator, '')) LIKE '%anthropic%' OR lower(concat_ws(' ', issuer, common_name)) LIKE '%anthropic%' THEN 'Anthropic' WHEN lower(coalesce(claim_generator, '')) LIKE '%claude%' THEN 'Anthropic (Claude)' END"


@registered(f"WITH {recipes.SIGNER_SQL} SELECT doc_id, {ATTRIBUTION_SQL} AS attribution FROM signed2")
def c_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.signer_documents(spark, sf_dir).select("doc_id", provenance.attribution(provenance.signer_of(F.col("document"))).alias("attribution"))


@registered(
    f"WITH {recipes.SIGNER_SQL}, said AS (SELECT doc_id, concat_ws(', ', 'attributed to ' || ({ATTRIBUTION_SQL}), 'generator ' || claim_generator, 'issuer ' || issuer, CASE WHEN common_name IS DISTINCT FROM issuer THEN 'signed by ' || common_name END, 'alg ' || alg, 'validation ' || validation_state) AS d, "
    "coalesce(issuer, common_name, alg, cert_serial, claim_generator, title, validation_state) IS NULL AS unsaid FROM signed2) SELECT doc_id, CASE WHEN unsaid THEN NULL WHEN d = '' THEN 'signer not stated' ELSE d END AS described FROM said"
)
def c_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.signer_documents(spark, sf_dir).select("doc_id", provenance.describe_signer(provenance.signer_of(F.col("document"))).alias("described"))


REMOTE = "CASE doc_id % 4 WHEN 0 THEN 'Remote: could not fetch from url https://h.example/' || doc_id || ' now' WHEN 1 THEN ' remote: refused' WHEN 2 THEN 'Other: from url x' ELSE 'REMOTE: no from url a' || doc_id END"


@registered(f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'https://h.example/' || doc_id WHEN 1 THEN '<unparsed>' WHEN 3 THEN 'a' || doc_id END AS url FROM documents")
def c_remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.documents(spark, sf_dir).select("doc_id", provenance.remote_url(F.expr(REMOTE)).alias("url"))


# A box after i % 50 bytes: its length is plausible, too long, open or too short, and its label near or far.
@registered("SELECT doc_id, doc_id % 3 <> 2 AND (doc_id % 4 IN (0, 2)) AS found FROM documents")
def c_jumbf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    lead = F.encode(F.repeat(F.lit("z"), (i % 50).cast("int")), "UTF-8")
    size = F.when(i % 4 == 0, F.lit(bytes([0, 0, 0, 40]))).when(i % 4 == 1, F.lit(b"text")).when(i % 4 == 2, F.lit(bytes(4))).otherwise(F.lit(bytes([0, 0, 0, 5])))
    gap = F.encode(F.when(i % 3 == 2, F.repeat(F.lit("-"), 70)).otherwise(F.repeat(F.lit("-"), 20)), "UTF-8")
    content = F.concat(lead, size, F.lit(b"jumb"), gap, F.lit(b"c2pa"), F.encode(F.repeat(F.lit("e"), 60), "UTF-8"))
    return recipes.documents(spark, sf_dir).select("doc_id", provenance.has_credentials(content).alias("found"))


@registered(f"WITH {recipes.INVENTORY_SQL}, q AS (SELECT path FROM files WHERE ord % 3 = 0) SELECT path, min(ord) AS ord FROM files WHERE path NOT IN (SELECT path FROM q) GROUP BY path")
def c_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recipes.inventory(spark, sf_dir)
    return gate.queued(rows.select("path", "ord"), rows.where("ord % 3 = 0").select("path"))


@registered("SELECT doc_id, doc_id % 5 IN (0, 1, 2) AS absolute, CASE doc_id % 5 WHEN 0 THEN 'b' || doc_id WHEN 1 THEN 'x' WHEN 2 THEN 'd.tex' WHEN 3 THEN 'rel.tex' ELSE '' END AS base FROM documents")
def c_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.expr(r"CASE doc_id % 5 WHEN 0 THEN concat(' /a/b', doc_id) WHEN 1 THEN '~/x' WHEN 2 THEN 'C:\\u\\d.tex' WHEN 3 THEN 'sub/rel.tex' ELSE '' END")
    return recipes.documents(spark, sf_dir).select("doc_id", paths.is_absolute(value).alias("absolute"), paths.basename(value).alias("base"))


# Reports


def sample_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes over the inventory: removals, kept things and errors that depend on ord."""
    rows = gate.provenance_of(recipes.inventory(spark, sf_dir)).withColumn("disposition", provenance.disposition(F.col("prov")))
    free, i = F.col("disposition") == provenance.SCRUB_FREELY, F.col("ord")
    one = lambda where, what, detail, applied: F.struct(F.lit(where).alias("where"), what.alias("what"), detail.alias("detail"), applied.alias("applied"))
    removals = F.filter(F.array(F.when(i % 2 == 0, one("EXIF", F.lit("GPS IFD"), F.lit(""), free)), F.when(i % 3 == 0, one("COM", F.concat(F.lit("c"), (i % 4).cast("string")), F.lit("seen"), F.lit(False)))), lambda x: x.isNotNull()).cast(REMOVALS)
    preserved = F.when(free & (i % 5 == 0), F.array(F.lit("licence header at line 1"), F.lit("word/document.bin"))).otherwise(F.array().cast("array<string>"))
    error = F.when(free & (i % 7 == 0), "ValueError: bad").otherwise(F.lit(None).cast("string"))
    return rows.select("ord", "path", "disposition", "prov", removals.alias("removals"), preserved.alias("preserved"), F.when(free & error.isNull() & (i % 4 == 0), F.concat("path", F.lit(".out"))).alias("written"), error.alias("error"))


OUTCOMES_SQL = (
    oracles.GATE_SQL
    + """,
outs AS (SELECT ord, path, disposition, provenance, sidecars, disposition = 'scrub_freely' AS free, CASE WHEN disposition = 'scrub_freely' AND ord % 7 = 0 THEN 'ValueError: bad' END AS error FROM disposed),
told AS (SELECT *, NOT free OR error IS NOT NULL AS refused, coalesce(error, CASE disposition WHEN 'refuse' THEN 'carries Content Credentials; scrubbing would invalidate them' WHEN 'refuse_is_manifest' THEN 'this file is a detached C2PA manifest, not an asset with metadata in it' END, '') AS reason,
  CASE WHEN free AND error IS NULL AND ord % 4 = 0 THEN path || '.out' END AS written, ord % 2 = 0 AS has_gps, ord % 3 = 0 AS has_com, free AND ord % 5 = 0 AS has_kept FROM outs)"""
)


@registered(OUTCOMES_SQL + " SELECT count(*) AS total, count(*) FILTER (refused) AS refused, count(*) FILTER (NOT refused) AS processed, max(refused::INT) AS exit_code, count(*) || ' file(s), ' || count(*) FILTER (refused) || ' refused, ' || count(*) FILTER (NOT refused) || ' processed' AS line FROM told")
def r_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.footer(sample_outcomes(spark, sf_dir))


@registered(OUTCOMES_SQL + " SELECT dir, max((refused)::INT) AS exit_code FROM told JOIN (SELECT ord AS o, dir FROM files) ON o = ord GROUP BY dir")
def r_exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exit code of a run over each folder."""
    rows = report.judged(sample_outcomes(spark, sf_dir)).withColumn("dir", F.substring_index("path", "/", 2))
    return rows.groupBy("dir").agg(F.bool_or("refused").cast("int").alias("exit_code"))


JSON_LIST = "'[' || array_to_string(list_transform({0}, lambda x: '\"' || x || '\"'), ',') || ']'"


@registered(
    OUTCOMES_SQL
    + ", lists AS (SELECT *, CASE WHEN has_gps AND free THEN ['EXIF: GPS IFD'] ELSE []::VARCHAR[] END AS done, list_filter([CASE WHEN has_gps AND NOT free THEN 'EXIF: GPS IFD' END, CASE WHEN has_com THEN 'COM: c' || (ord % 4) || ' (seen)' END], lambda x: x IS NOT NULL) AS seen, CASE WHEN has_kept THEN ['licence header at line 1', 'word/document.bin'] ELSE []::VARCHAR[] END AS kept FROM told) "
    + "SELECT ord, '{\"path\":\"' || path || '\",\"disposition\":\"' || disposition || '\",\"refused\":' || refused || ',\"reason\":\"' || reason || '\",\"provenance\":\"' || provenance || '\",\"attribution\":null,\"signer\":null,\"sidecars\":' || "
    + JSON_LIST.format("sidecars") + " || ',\"removals\":' || " + JSON_LIST.format("done") + " || ',\"found\":' || " + JSON_LIST.format("seen") + " || ',\"preserved\":' || " + JSON_LIST.format("kept") + " || ',\"written\":' || coalesce('\"' || written || '\"', 'null') || '}' AS json FROM lists"
)
def r_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.json_rows(sample_outcomes(spark, sf_dir))


@registered(
    OUTCOMES_SQL
    + ", lined AS (SELECT ord, CASE WHEN refused THEN ['REFUSED  ' || path, repeat(' ', 9) || reason, CASE WHEN NOT free THEN repeat(' ', 9) || 'found: ' || provenance END, CASE WHEN has_gps THEN repeat(' ', 9) || 'found: EXIF: GPS IFD' END, CASE WHEN has_com THEN repeat(' ', 9) || 'found: COM: c' || (ord % 4) || ' (seen)' END, "
    + f"CASE WHEN has_gps OR has_com THEN repeat(' ', 9) || '{report.NO_SAFE_EDIT}' END] ELSE ['OK       ' || path || coalesce(' -> ' || written, ''), CASE WHEN NOT has_gps AND NOT has_com THEN repeat(' ', 9) || 'nothing to remove' END, CASE WHEN has_gps THEN repeat(' ', 9) || CASE WHEN written IS NULL THEN 'would remove' ELSE 'removed' END || ': EXIF: GPS IFD' END, "
    + "CASE WHEN has_com THEN repeat(' ', 9) || 'found: COM: c' || (ord % 4) || ' (seen)' END, CASE WHEN has_kept THEN repeat(' ', 9) || 'preserved: licence header at line 1' END] END AS lines FROM told) SELECT ord, array_to_string(list_filter(lines, lambda x: x IS NOT NULL), chr(10)) AS text FROM lined"
)
def r_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.text_rows(sample_outcomes(spark, sf_dir))


@registered(OUTCOMES_SQL + ", counted AS (SELECT ord, (has_gps AND free)::BIGINT AS applied, (has_gps AND NOT free)::BIGINT + has_com::BIGINT AS found FROM told) SELECT applied, found, count(*) AS files FROM counted GROUP BY applied, found")
def r_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sample_outcomes(spark, sf_dir).select(F.size(report.applied(F.col("removals"))).cast("long").alias("applied"), F.size(report.applied(F.col("removals"), False)).cast("long").alias("found"))
    return rows.groupBy("applied", "found").agg(F.count(F.lit(1)).alias("files"))


@registered(OUTCOMES_SQL + " SELECT path, 'GPS IFD' AS fields FROM told WHERE has_gps AND free GROUP BY path")
def r_removed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sample_outcomes(spark, sf_dir).select("path", F.inline("removals"))
    return report.removed_fields(rows).withColumn("fields", F.array_join("fields", ","))


@registered("WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) SELECT source, count(*) AS count, 'lines ' || array_to_string(list(doc_id ORDER BY doc_id) FILTER (k <= 5), ', ') || CASE WHEN count(*) > 5 THEN ', ...' ELSE '' END AS summary FROM r GROUP BY source")
def r_first5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.first_lines(recipes.documents(spark, sf_dir).select("source", "doc_id"), "source", "doc_id")


# Formats by content

HEADS = [(b"\xff\xd8\xff", ".tex", "jpeg"), (b"\x89PNG\r\n\x1a\nxx", ".jpg", "png"), (b"%PDF-1.7", ".x", "pdf"), (b"PK\x03\x04 [Content_Types].xml", ".zip", "docx"), (b"PK\x03\x04 other", ".zip", None), (b"a plain note", ".txt", None), (b"prose quoting \\usepackage", ".txt", None), (b"\\documentclass{a}", ".dat", "latex")]
HEADS += [(b"@book{k, a={b}}", "", "bibtex"), (b"%<*driver>\n\\documentclass{a}", ".txt", "latex-docstrip"), (b"anything", ".STY", "latex-package"), (b"\xff\xfea\x00", ".tex", None), (b"a\x00b", ".bib", None), (b"@book{k} \\documentclass{a}", ".txt", "latex"), (b"x", ".ins", "latex-docstrip"), (b"", ".ltx", "latex")]


@registered("SELECT doc_id, ([" + ", ".join("NULL" if f is None else f"'{f}'" for _, _, f in HEADS) + f"])[1 + (doc_id % {len(HEADS)})::INT] AS format FROM documents")
def s_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = (F.col("doc_id") % len(HEADS)).cast("int")
    rows = recipes.documents(spark, sf_dir).select("doc_id", F.get(F.array(*(F.lit(h) for h, _, _ in HEADS)), i).alias("content"), F.get(F.array(*(F.lit(s) for _, s, _ in HEADS)), i).alias("suffix"))
    return rows.select("doc_id", sniff.format_of(F.col("content"), F.col("suffix")).alias("format"))


@registered("SELECT doc_id, doc_id % 3 = 0 AS strong, doc_id % 3 <> 2 AS weak, doc_id % 5 = 0 AS bib, doc_id % 7 = 0 AS docstrip FROM documents")
def s_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(r"concat(CASE doc_id % 3 WHEN 0 THEN '\\documentclass{a}' WHEN 1 THEN '\\usepackage{b}' ELSE 'none' END, CASE WHEN doc_id % 5 = 0 THEN '@misc {k}' ELSE '' END, CASE WHEN doc_id % 7 = 0 THEN '\n%<*x>' ELSE '\n% <x' END)")
    rows = recipes.documents(spark, sf_dir).select("doc_id", F.encode(text, "UTF-8").alias("content"))
    c = F.col("content")
    return rows.select("doc_id", sniff.looks_like_latex(c, True).alias("strong"), sniff.looks_like_latex(c).alias("weak"), sniff.looks_like_bib(c).alias("bib"), sniff.looks_like_docstrip(c).alias("docstrip"))


# TeX and BibTeX


def part(k: int) -> str:
    return f"(doc_id + {k}) % 3 <> 1"


@registered(f"SELECT 'f' || doc_id || '.tex' AS path, {recipes.tex_sql(True)} AS scrubbed FROM documents")
def l_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scrubbed(recipes.tex_files(spark, sf_dir)).select("path", F.decode("content", "UTF-8").alias("scrubbed"))


def tex_removals(spark: SparkSession, sf_dir: str, policy: Policy = Policy()) -> DataFrame:
    return scrub_rows(recipes.tex_files(spark, sf_dir), policy).select("path", F.inline("removals"))


def counted(name: str, condition: str, sql: str, policy: Policy = Policy()) -> None:
    """A query that counts removals of a kind by file; sql is its number for a document."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tex_removals(spark, sf_dir, policy).where(condition).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.bool_and("applied").alias("applied"))

    applied = "false" if name in ("l_paths", "l_revisions", "l_hidden", "l_sources") else "true"
    registered(f"SELECT 'f' || doc_id || '.tex' AS path, {sql} AS n, {applied} AS applied FROM documents WHERE {sql} > 0", name)(query)


is_ = lambda k: f"({part(k)})::BIGINT"
counted("l_identity", r"`where` IN ('\\author', '\\email')", f"{is_(3)} + {is_(4)}")
counted("l_dates", r"`where` = '\\date'", is_(5), Policy(strip_dates=True))
counted("l_hypersetup", r"`where` = '\\hypersetup'", is_(6))
counted("l_pdfinfo", r"`where` = '\\pdfinfo'", f"2 * {is_(7)}")
counted("l_paths", "what = 'absolute path'", is_(10))
counted("l_revisions", "what = 'revision author'", is_(11))
counted("l_anonymised", "what = 'revision author'", is_(11), Policy(strip_revisions=True))
counted("l_sources", "what LIKE 'references%'", is_(12))
counted("l_hidden", "detail LIKE '%hidden from the rendered document'", f"{is_(13)} + 2 * {is_(14)}")
counted("l_magic", "what LIKE '%directive path'", is_(1))


@registered(f"SELECT 'f' || doc_id || '.tex' AS path, ({is_(4)} + {is_(11)}) || ' comment body(s) truncated' AS what FROM documents WHERE {is_(4)} + {is_(11)} > 0")
def l_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tex_removals(spark, sf_dir).where("`where` = 'LaTeX comments'").select("path", "what")


@registered(f"SELECT kind, sum(n)::BIGINT AS n FROM (SELECT 'opaque' AS kind, 2 * {is_(8)} + {is_(9)} + {is_(13)} AS n FROM documents UNION ALL SELECT 'comment', {is_(1)} + {is_(2)} + {is_(4)} + {is_(11)} + {is_(12)} FROM documents) GROUP BY kind")
def l_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.tex_spans(recipes.tex_files(spark, sf_dir)).where("kind <> 'control'").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@registered("SELECT doc_id, doc_id % 2 = 0 AS hazard FROM documents")
def l_catcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(r"concat('\\documentclass{a}\n', CASE WHEN doc_id % 2 = 0 THEN '\\catcode`\\%=12' ELSE '\\catcode`@=11' END, '\n\\author{A}% x')")
    files = recipes.documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.lit(".tex").alias("suffix"), F.encode(text, "UTF-8").alias("content"))
    return scrub_rows(files).select(F.col("path").cast("long").alias("doc_id"), (~F.col("changed")).alias("hazard"))


STY = "%% pkg {0}\n%% (c) Ann {0}\n%% more {0}\n\\ProvidesPackage{{p}}\n\\author{{A {0}}}\n\\def\\x{{y}} % aside {0}\n% License: {0}\n"
STY_DONE = "%% pkg {0}\n%% (c) Ann {0}\n%% more {0}\n\\ProvidesPackage{{p}}\n\\author{{}}\n\\def\\x{{y}} %\n% License: {0}\n"
DTX = "% \\iffalse\n%<*driver>\n\\author{{A {0}}}\n%</driver>\n% \\fi\n% prose 100% {0}\n\\def\\x{{y}} % code {0}\n"
DTX_DONE = "% \\iffalse\n%<*driver>\n\\author{{}}\n%</driver>\n% \\fi\n% prose 100% {0}\n\\def\\x{{y}} %\n"


def templated(name: str, suffix: str, before: str, after: str) -> None:
    def text(t: str):
        pieces = t.replace("{{", "\x01").replace("}}", "\x02").split("{0}")
        out = []
        for k, piece in enumerate(pieces):
            out += [F.col("doc_id").cast("string")] if k else []
            out.append(F.lit(piece.replace("\x01", "{").replace("\x02", "}")))
        return F.concat(*out)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = recipes.documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.lit(suffix).alias("suffix"), F.encode(text(before), "UTF-8").alias("content"))
        return scrub_rows(files).select(F.col("path").cast("long").alias("doc_id"), F.decode("data", "UTF-8").alias("scrubbed"))

    sql = "'" + after.replace("{{", "{").replace("}}", "}").replace("\n", "' || chr(10) || '").replace("{0}", "' || doc_id || '") + "'"
    registered(f"SELECT doc_id, {sql} AS scrubbed FROM documents", name)(query)


templated("l_sty", ".sty", STY, STY_DONE)
templated("l_dtx", ".dtx", DTX, DTX_DONE)


@registered(f"SELECT 'f' || doc_id || '.bib' AS path, {recipes.bib_text(True, True)} AS scrubbed FROM documents")
def b_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scrubbed(recipes.bib_files(spark, sf_dir)).select("path", F.decode("content", "UTF-8").alias("scrubbed"))


def has_field(k: int) -> str:
    return f"((doc_id + {k}) % 3 <> 0)::BIGINT"


@registered("SELECT name, sum(n)::BIGINT AS n FROM (" + " UNION ALL ".join(f"SELECT {name} AS name, {has_field(k)} AS n FROM documents" for k, name in enumerate(["'author'", "'file'", "'note'", "'owner'", "'timestamp'", "'bdsk-file-' || (doc_id % 13)", "'url'", "'pdf'"])) + ") GROUP BY name HAVING sum(n) > 0")
def b_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.bib_fields(recipes.bib_files(spark, sf_dir)).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@registered("SELECT what, sum(n)::BIGINT AS occurrences FROM (" + " UNION ALL ".join(f"SELECT {name} AS what, {has_field(k)} AS n FROM documents" for k, name in ((1, "'file'"), (3, "'owner'"), (5, "'bdsk-file-' || (doc_id % 13)"), (7, "'pdf'"), (4, "'timestamp'"))) + ") GROUP BY what HAVING sum(n) > 0")
def b_field_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scrub_rows(recipes.bib_files(spark, sf_dir), Policy(strip_dates=True)).select("path", F.inline("removals"))
    return rows.groupBy("what").agg(F.sum(F.regexp_extract("detail", r"^(\d+)", 1).cast("long")).alias("occurrences"))


# Pictures and office documents, from crafted bytes


def crafted(name: str, kind: str, sql: str, policy: Policy = Policy()) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = scrub_rows(samples.files(recipes.documents(spark, sf_dir), kind), policy)
        shown = F.array_join(F.transform("removals", report.removal_text), "; ")
        return rows.select(F.col("path").cast("long").alias("doc_id"), "format", shown.alias("removals"), F.array_join("preserved", "; ").alias("preserved"), "changed", "error")

    registered(sql, name)(query)


def row_sql(fmt: str, removals: str, preserved: str) -> str:
    return f"SELECT doc_id, '{fmt}' AS format, concat_ws('; ', {removals}) AS removals, {preserved} AS preserved, concat_ws('; ', {removals}) <> '' AS changed, NULL::VARCHAR AS error FROM documents"


def when(k: int, text: str) -> str:
    return f"CASE WHEN doc_id % {k} = 0 THEN '{text}' END"


EXIF_SQL = ", ".join([when(5, "EXIF: IFD1 thumbnail (may predate cropping or redaction)"), when(3, "EXIF: GPS IFD (entire location record)"), when(2, "EXIF IFD0: Make"), when(2, "EXIF IFD0: Artist"), when(4, "EXIF SubIFD: BodySerialNumber")])
XMP_SQL = ", ".join([when(2, "XMP: xmp:CreatorTool"), when(3, "XMP: GPSLatitude (location)"), when(4, "XMP: dc:creator")])
crafted("x_jpeg_scrub", "jpeg", row_sql("jpeg", f"{EXIF_SQL}, {XMP_SQL}, {when(6, 'APP1: extended XMP packet')}, {when(7, 'APP13: Photoshop/IPTC resource block')}, {when(2, 'COM: comment segment')}", "'APP2 (ICC colour profile)'"))
crafted("x_png_scrub", "png", row_sql("png", f"{when(2, 'chunk tEXt: Author')}, {XMP_SQL}, {EXIF_SQL}", "''"))
crafted("x_png_dates", "png", row_sql("png", f"{when(2, 'chunk tEXt: Author')}, {when(3, 'chunk tIME: last-modified timestamp')}, {XMP_SQL}, {EXIF_SQL}", "''"), Policy(strip_dates=True))


def pdf_sql(text: str) -> str:
    """The text as SQL, with # for the row's id."""
    return "replace('" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "', '#', lpad(doc_id::VARCHAR, 9, '0'))"


def pdf_scrubbed(author: bool, producer: bool) -> str:
    """What DocInfo should be: blanks where an entry was."""
    out = samples.pdf_info(author, producer)
    for gone in ["/Cre@61tor 5 0 R", *(["/Author (Ann \\(#\\))"] if author else []), *(["/Producer <41626364>"] if producer else [])]:
        assert gone in out
        out = out.replace(gone, " " * (len(gone) + 8 * gone.count("#")))
    return out


PDF_HEAD = samples.pdf(1).index(b"3 0 obj")
PDF_REMOVED = f"concat_ws('; ', {when(2, 'PDF DocInfo: Author')}, 'PDF DocInfo: Creator', {when(3, 'PDF DocInfo: Producer')}, 'PDF XMP: pdf:Producer')"


@registered(
    f"SELECT doc_id, 'pdf' AS format, {PDF_REMOVED} AS removals, '/AF associated files' AS preserved, {len(samples.pdf(1))} AS n_bytes, sha256(CASE "
    + " ".join(f"WHEN (doc_id % 2 = 0) = {a} AND (doc_id % 3 = 0) = {p} THEN {pdf_sql(pdf_scrubbed(a, p))}" for a in (True, False) for p in (True, False))
    + f" END) AS info_sha256, sha256({pdf_sql('5 0 obj' + chr(10) + '()' + ' ' * 14 + chr(10) + 'endobj' + chr(10))}) AS creator_sha256 FROM documents"
)
def x_pdf_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removals from PDFs, and the bytes of the objects that held them."""
    rows = scrub_rows(samples.files(recipes.documents(spark, sf_dir), "pdf"))
    info, creator = len(samples.pdf_info(True, True)) + 16, samples.pdf(1).index(b"5 0 obj")
    cut = lambda at, n: F.sha2(F.substring("data", at + 1, n), 256)
    return rows.select(F.col("path").cast("long").alias("doc_id"), "format", F.array_join(F.transform("removals", report.removal_text), "; ").alias("removals"), F.array_join("preserved", "; ").alias("preserved"), F.octet_length("data").alias("n_bytes"), cut(PDF_HEAD, info).alias("info_sha256"), cut(creator, 32).alias("creator_sha256"))


DOCX_SQL = ", ".join([when(2, "docProps/core.xml: creator"), when(3, "docProps/app.xml: Company"), when(4, "word/settings.xml: w:rsid revision-session identifiers")])
crafted("x_docx", "docx", f"SELECT doc_id, 'docx' AS format, concat_ws('; ', {DOCX_SQL}, {when(5, 'word/document.xml: tracked-change authors (reported only; use --strip-revisions to anonymise)')}) AS removals, 'word/media/a.bin' AS preserved, concat_ws('; ', {DOCX_SQL}) <> '' AS changed, NULL::VARCHAR AS error FROM documents")
crafted("x_docx_revisions", "docx", row_sql("docx", f"{DOCX_SQL}, {when(5, 'word/document.xml: 1 tracked-change author name(s) (anonymised)')}", "'word/media/a.bin'"), Policy(strip_revisions=True))


def after(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return scrubbed(samples.files(recipes.documents(spark, sf_dir), kind))


def own_id() -> Column:
    return F.col("path").cast("long").alias("doc_id")


@registered(
    "SELECT doc_id, ifd, tag, value, sha256(unhex('FFDA00067363616E12FF0034') || encode(doc_id::VARCHAR) || unhex('FFD9')) AS scan_sha256 FROM documents, "
    "(VALUES ('Exif', 33434, '010000003C000000'), ('IFD0', 274, '0600'), ('IFD0', 34665, NULL)) AS t(ifd, tag, value)"
)
def x_jpeg_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXIF entries that scrubbed files hold, and their picture, whose bytes are the last ones."""
    files = after(spark, sf_dir, "jpeg")
    tail = F.length("path") + F.lit(14)
    scans = files.select("path", F.sha2(F.substring("content", F.length("content") - tail + 1, tail), 256).alias("scan_sha256"))
    left = units.exif_entries(files).select("path", "ifd", "tag", F.when(F.col("tag") != 0x8769, F.hex("value")).alias("value"))
    return left.join(scans, "path").select(own_id(), "ifd", "tag", "value", "scan_sha256")


@registered(
    "SELECT doc_id, seq, type, CASE type WHEN 'tEXt' THEN 'Title' || chr(0) || 'kept' WHEN 'tIME' THEN repeat(chr(0), 7) WHEN 'IEND' THEN '' END AS data FROM "
    "(SELECT doc_id, type, (row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1)::INT AS seq FROM documents, "
    "(VALUES (0, 'IHDR'), (1, 'tEXt'), (2, 'tIME'), (3, 'iTXt'), (4, 'eXIf'), (5, 'IDAT'), (6, 'IEND')) AS t(place, type) WHERE type <> 'tIME' OR doc_id % 3 = 0)"
)
def x_png_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that scrubbed files hold, in order."""
    data = F.when(F.col("type").isin("tEXt", "tIME", "IEND"), F.decode("data", "ISO-8859-1"))
    return units.png_chunks(after(spark, sf_dir, "png")).select(own_id(), "seq", "type", data.alias("data"))


@registered(
    "SELECT doc_id, entry, CASE entry WHEN '[Content_Types].xml' THEN '<Types/>' WHEN 'word/media/a.bin' THEN 'data ' || doc_id END AS text, entry = 'word/document.xml' AND doc_id % 5 = 0 AS named "
    "FROM documents, (SELECT unnest(['[Content_Types].xml', 'docProps/core.xml', 'docProps/app.xml', 'word/settings.xml', 'word/document.xml', 'word/media/a.bin']) AS entry)"
)
def x_docx_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that scrubbed files hold, and whether they still name anyone: changes do, which are only reported."""
    body = F.decode("payload", "UTF-8")
    text = F.when(F.col("entry").isin("[Content_Types].xml", "word/media/a.bin"), body)
    return units.zip_entries(after(spark, sf_dir, "docx")).select(own_id(), "entry", text.alias("text"), body.rlike("Annie|Firmco|w:rsidRoot").alias("named"))


@registered("SELECT type, sum(n)::BIGINT AS n FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS type, {n} AS n FROM documents" for t, n in (("IHDR", "1"), ("IDAT", "1"), ("IEND", "1"), ("tEXt", "1 + (doc_id % 2 = 0)::INT"), ("iTXt", "1"), ("eXIf", "1"), ("tIME", "(doc_id % 3 = 0)::INT"))) + ") GROUP BY type")
def x_png_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.png_chunks(samples.files(recipes.documents(spark, sf_dir), "png")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@registered("SELECT marker, sum(n)::BIGINT AS n FROM (" + " UNION ALL ".join(f"SELECT {m} AS marker, {n} AS n FROM documents" for m, n in ((0xD8, "1"), (0xE1, "2 + (doc_id % 6 = 0)::INT"), (0xE2, "1"), (0xED, "(doc_id % 7 = 0)::INT"), (0xFE, "(doc_id % 2 = 0)::INT"))) + ") GROUP BY marker HAVING sum(n) > 0")
def x_jpeg_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.jpeg_segments(samples.files(recipes.documents(spark, sf_dir), "jpeg")).groupBy("marker").agg(F.count(F.lit(1)).alias("n"))


@registered("SELECT ifd, tag, sum(n)::BIGINT AS n FROM (" + " UNION ALL ".join(f"SELECT '{d}' AS ifd, {t} AS tag, {n} AS n FROM documents" for d, t, n in (("IFD0", 0x0112, "1"), ("IFD0", 0x8769, "1"), ("IFD0", 0x010F, "(doc_id % 2 = 0)::INT"), ("IFD0", 0x013B, "(doc_id % 2 = 0)::INT"), ("IFD0", 0x8825, "(doc_id % 3 = 0)::INT"), ("GPS", 1, "(doc_id % 3 = 0)::INT"), ("Exif", 0x829A, "1"), ("Exif", 0xA431, "(doc_id % 4 = 0)::INT"), ("IFD1", 0x0103, "(doc_id % 5 = 0)::INT"))) + ") GROUP BY ifd, tag HAVING sum(n) > 0")
def x_exif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.exif_entries(samples.files(recipes.documents(spark, sf_dir), "jpeg")).groupBy("ifd", "tag").agg(F.count(F.lit(1)).alias("n"))


@registered("SELECT kind, local, sum(n)::BIGINT AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, '{t}' AS local, {n} AS n FROM documents" for k, t, n in (("element", "xmpmeta", "1"), ("element", "RDF", "1"), ("element", "Description", "1"), ("attribute", "Rating", "1"), ("attribute", "CreatorTool", "(doc_id % 2 = 0)::INT"), ("attribute", "GPSLatitude", "(doc_id % 3 = 0)::INT"), ("element", "creator", "(doc_id % 4 = 0)::INT"))) + ") GROUP BY kind, local HAVING sum(n) > 0")
def x_xmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.xmp_properties(samples.files(recipes.documents(spark, sf_dir), "xmp")).groupBy("kind", "local").agg(F.count(F.lit(1)).alias("n"))


@registered("SELECT entry, count(*) AS n FROM (SELECT unnest(['[Content_Types].xml', 'docProps/core.xml', 'docProps/app.xml', 'word/settings.xml', 'word/document.xml', 'word/media/a.bin']) AS entry FROM documents) GROUP BY entry")
def x_zip_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.zip_entries(samples.files(recipes.documents(spark, sf_dir), "docx")).groupBy("entry").agg(F.count(F.lit(1)).alias("n"))


@registered("SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'embedded' WHEN doc_id % 4 = 2 THEN 'remote https://m.example/' || doc_id WHEN doc_id % 4 = 3 THEN 'unrecognized' ELSE 'none' END AS state FROM documents")
def x_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What contents say about credentials: an embedded store, a remote reference, a picture cut short, nothing."""
    from ..operators.scrub import facts

    rows = facts(samples.files(recipes.documents(spark, sf_dir), "credentials"))
    state = F.when(F.col("embedded"), "embedded").when(F.col("remote_url").isNotNull(), F.concat(F.lit("remote "), "remote_url")).when(F.col("unrecognized").isNotNull(), "unrecognized").otherwise("none")
    return rows.select(F.col("path").cast("long").alias("doc_id"), state.alias("state"))


# Whole runs over files on disk

TREE_SQL = (
    f"WITH files AS (SELECT doc_id, (doc_id % 7) || '/f' || doc_id || '.tex' AS path, doc_id % 5 = 0 AS signed, false AS manifest, {recipes.tex_sql(False)} AS raw, {recipes.tex_sql(True)} AS clean FROM documents "
    "UNION ALL SELECT doc_id, (doc_id % 7) || '/f' || doc_id || '.c2pa', true, true, '', '' FROM documents WHERE doc_id % 5 = 0) "
    "SELECT row_number() OVER (ORDER BY path) - 1 AS ord, path, CASE WHEN manifest THEN 'refuse_is_manifest' WHEN signed THEN 'refuse' ELSE 'scrub_freely' END AS disposition, {column} FROM files"
)


def planted(spark: SparkSession, sf_dir: str) -> str:
    """A folder whose folder `in` holds a TeX file a document, in seven folders, and a manifest beside each fifth."""
    folder = re.sub(r"^([a-z0-9]+):/(?!/)", r"\1:///", scratch(spark, "tree"))
    rows = recipes.tex_files(spark, sf_dir).withColumn("doc_id", F.regexp_extract("path", r"\d+", 0).cast("long"))
    place = lambda suffix: F.concat(F.lit(f"{folder}/in/"), F.col("doc_id") % 7, F.lit("/f"), F.col("doc_id"), F.lit(suffix)).alias("destination")
    manifests = rows.where(F.col("doc_id") % 5 == 0).select("path", place(".c2pa"), F.encode(F.lit("manifest"), "UTF-8").alias("data"))
    files.write_rows(rows.select("path", place(".tex"), F.col("content").alias("data")).unionByName(manifests)).write.format("noop").mode("overwrite").save()
    return folder


def below(folder: str) -> Column:
    return F.substring("path", len(folder) + 5, 2**30).alias("path")


@registered(TREE_SQL.replace("{column}", "NOT manifest AND raw <> clean AS found"))
def p_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What inspecting a folder says of every file in it, in the order of a visit."""
    folder = planted(spark, sf_dir)
    rows = run.inspect(spark, [f"{folder}/in"], recursive=True)
    changing = F.exists("removals", lambda r: ~r["what"].like("references%") & (r["what"] != "absolute path"))
    return rows.select("ord", below(folder), "disposition", changing.alias("found"))


@registered(TREE_SQL.replace("{column}", "CASE WHEN NOT signed AND raw <> clean THEN clean END AS scrubbed"))
def p_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scrubbing a folder into another: every file's outcome, and the text that was written."""
    folder = planted(spark, sf_dir)
    rows = run.scrub(spark, [f"{folder}/in"], recursive=True, output_dir=f"{folder}/out")
    named = rows.select("ord", below(folder).alias("of"), "disposition", F.coalesce("written", F.lit(f"{folder}/none")).alias("path"), F.lit(".tex").alias("suffix"))
    return files.with_content(named).select("ord", F.col("of").alias("path"), "disposition", F.decode("content", "UTF-8").alias("scrubbed"))
