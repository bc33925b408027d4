"""SQL for DuckDB that tells what the registered queries return, written without this library's patterns or parsers."""

from __future__ import annotations

from ..functions import chars
from . import recipes


def in_list(column: str, points) -> str:
    return f"{column} IN ({', '.join(str(p) for p in sorted(points))})"


def beside(column: str) -> str:
    return f"EXISTS (SELECT 1 FROM ranges r WHERE {column} BETWEEN r.lo AND r.hi)"


def ranges_sql() -> str:
    return "ranges AS (SELECT unnest([" + ", ".join(str(a) for a, _ in chars.context_ranges()) + "]) AS lo, unnest([" + ", ".join(str(b) for _, b in chars.context_ranges()) + "]) AS hi)"


SENTINEL = 0xE0001
STRAY = f"[{chars.TAG_FIRST}-{chars.TAG_CANCEL}]"


def characters_sql(typography: bool = False, inserts: list[str] = recipes.INSERTS) -> str:
    """CTEs up to `marked`: every special character with its neighbours. Only texts with something special are unnested."""
    everything = [0x200C, 0x200D, 0xFEFF, SENTINEL, *chars.INVISIBLE_NAMES, *chars.BIDI_NAMES, *(chars.TYPOGRAPHY if typography else ())]
    special = "[" + "".join(map(chr, everything)) + chars.TAG_FIRST + "-" + chars.TAG_CANCEL + "]"
    return f"""{recipes.noisy_sql(inserts)}, {ranges_sql()},
prepared AS (SELECT doc_id, lang, text, regexp_replace(text, '({chars.SEQUENCE})|{STRAY}', '\\1' || chr({SENTINEL}), 'g') AS t0 FROM noisy),
sentinels AS (SELECT doc_id, lang, text, regexp_replace(t0, '({chars.SEQUENCE})' || chr({SENTINEL}), '\\1', 'g') AS t FROM prepared),
hits AS (SELECT doc_id, t FROM sentinels WHERE regexp_matches(t, '{special}')),
letters AS (SELECT doc_id, unnest(string_split(t, '')) AS ch, generate_subscripts(string_split(t, ''), 1) AS p, t FROM hits),
coded AS (SELECT doc_id, ch, p, unicode(ch) AS cp FROM letters),
around AS (SELECT *, lag(cp) OVER w AS before, lead(cp) OVER w AS after FROM coded WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
marked AS (SELECT a.*, cp IN (8204, 8205) AS joiner, cp IN (8204, 8205) AND ({beside('before')} OR {beside('after')}) AS joined FROM around a)"""


def gone(keep_bidi: bool = False, strip_bom: bool = False) -> str:
    points = [*chars.INVISIBLE_NAMES, *([] if keep_bidi else chars.BIDI_NAMES)]
    return f"({in_list('cp', points)} OR cp = {SENTINEL} OR (joiner AND NOT joined) OR (cp = 65279{'' if strip_bom else ' AND p > 1'}))"


def cleaned_sql(keep_bidi: bool = False, strip_bom: bool = False, ascii_punct: bool = False, inserts: list[str] = recipes.INSERTS) -> str:
    """CTEs up to `cleaned` (doc_id, lang, text, clean)."""
    ch = "ch"
    if ascii_punct:
        quote = lambda s: "'" + s.replace("'", "''") + "'"
        ch = "CASE cp " + " ".join(f"WHEN {cp} THEN {quote(to)}" for cp, (to, _) in chars.TYPOGRAPHY.items()) + " ELSE ch END"
    return f"""WITH {characters_sql(ascii_punct, inserts)},
kept AS (SELECT doc_id, coalesce(string_agg({ch}, '' ORDER BY p), '') AS clean FROM marked WHERE NOT {gone(keep_bidi, strip_bom)} GROUP BY doc_id),
cleaned AS (SELECT n.doc_id, n.lang, n.text, CASE WHEN h.doc_id IS NULL THEN n.text ELSE coalesce(k.clean, '') END AS clean FROM noisy n LEFT JOIN hits h ON n.doc_id = h.doc_id LEFT JOIN kept k ON n.doc_id = k.doc_id)"""


def text_sql(**options) -> str:
    return cleaned_sql(**options) + " SELECT doc_id, clean FROM cleaned"


def findings_sql() -> str:
    """CTEs up to `found` (doc_id, pos, codepoint, name, line, column, action, reason, lang)."""
    names = " ".join(f"WHEN {cp} THEN '{name}'" for cp, name in sorted(chars.NAMES.items()))
    bidi, invisible = in_list("cp", chars.BIDI_NAMES), in_list("cp", chars.INVISIBLE_NAMES)
    return f"""WITH {characters_sql()},
strays AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k, p FROM marked WHERE cp = {SENTINEL}),
stray_points AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(regexp_replace(text, '{chars.SEQUENCE}', '', 'g'), '{STRAY}'), lambda c: unicode(c))) AS point, generate_subscripts(regexp_extract_all(regexp_replace(text, '{chars.SEQUENCE}', '', 'g'), '{STRAY}'), 1) AS k FROM noisy WHERE doc_id IN (SELECT doc_id FROM hits)),
placed AS (SELECT m.*, 1 + count(*) FILTER (cp = 10) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS line,
  sum(CASE WHEN cp = 10 OR cp = {SENTINEL} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS walked FROM marked m),
columned AS (SELECT p.*, 1 + walked - (CASE WHEN cp = 10 OR cp = {SENTINEL} THEN 0 ELSE 1 END) - coalesce(max(CASE WHEN cp = 10 THEN walked END) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS col FROM placed p),
shown AS (SELECT c.*, s.k FROM columned c LEFT JOIN strays s ON c.doc_id = s.doc_id AND c.p = s.p WHERE {invisible} OR {bidi} OR joiner OR cp = {SENTINEL} OR (cp = 65279 AND c.p > 1)),
pointed AS (SELECT s.*, coalesce(q.point, s.cp) AS codepoint FROM shown s LEFT JOIN stray_points q ON s.doc_id = q.doc_id AND s.k = q.k),
found AS (SELECT f.doc_id, n.lang, row_number() OVER (PARTITION BY f.doc_id ORDER BY f.p) - 1 AS pos, f.codepoint, CASE f.codepoint {names} ELSE 'TAG U+' || upper(to_hex(f.codepoint)) END AS name, f.line::INT AS line, f.col::INT AS "column",
  CASE WHEN joined THEN 'kept' ELSE 'removed' END AS action,
  CASE WHEN cp = {SENTINEL} THEN 'outside an emoji tag sequence' WHEN joined THEN 'joins adjacent script or emoji' WHEN joiner THEN 'isolated between non-joining characters' WHEN cp = 65279 THEN 'mid-text' WHEN {bidi} THEN 'bidi control' ELSE '' END AS reason
  FROM pointed f JOIN noisy n ON f.doc_id = n.doc_id)"""


RENDERED = "printf('U+%04X %s — line %d, col %d: %s', codepoint, name, line, \"column\", action) || CASE WHEN reason = '' THEN '' ELSE ' (' || reason || ')' END"

# Sidecars and assets: names compared as they are, manifests whatever the case of their suffix.
GATE_SQL = f"""WITH {recipes.INVENTORY_SQL},
manifests AS (SELECT DISTINCT dir AS m_dir, stem AS m_key, path AS m_path FROM files WHERE lower(suffix) = '.c2pa'),
assets AS (SELECT DISTINCT path, dir, name, stem, suffix FROM files WHERE lower(suffix) <> '.c2pa'),
pairs AS (SELECT DISTINCT a.path, m.m_path, CASE WHEN m.m_key = a.stem THEN 0 ELSE 1 END AS spelling FROM assets a JOIN manifests m ON a.dir = m.m_dir AND (m.m_key = a.stem OR m.m_key = a.name)),
sides AS (SELECT path, list(m_path ORDER BY spelling, m_path) AS sidecars FROM pairs GROUP BY path),
owned AS (SELECT DISTINCT m.m_path, a.path, CASE WHEN a.name = m.m_key THEN 0 ELSE 1 END AS later FROM assets a JOIN manifests m ON a.dir = m.m_dir AND ((a.name = m.m_key AND a.suffix <> '') OR starts_with(a.name, m.m_key || '.'))),
belongs AS (SELECT m_path AS path, list(path ORDER BY later, path) AS manifest_assets FROM owned GROUP BY m_path),
gated AS (SELECT f.*, lower(f.suffix) = '.c2pa' AS is_manifest, CASE WHEN lower(f.suffix) = '.c2pa' THEN [] ELSE coalesce(s.sidecars, []) END AS sidecars, coalesce(b.manifest_assets, []) AS manifest_assets FROM files f LEFT JOIN sides s ON f.path = s.path LEFT JOIN belongs b ON f.path = b.path),
disposed AS (SELECT *, CASE WHEN is_manifest THEN 'refuse_is_manifest' WHEN len(sidecars) > 0 THEN 'refuse' ELSE 'scrub_freely' END AS disposition,
  CASE WHEN is_manifest AND len(manifest_assets) > 0 THEN 'detached C2PA manifest for ' || array_to_string(list_transform(manifest_assets, lambda a: regexp_extract(a, '[^/]*$')), ', ') WHEN is_manifest THEN 'detached C2PA manifest, orphaned (no asset of that name beside it)'
    WHEN len(sidecars) > 0 THEN array_to_string(list_transform(sidecars, lambda a: 'sidecar ' || regexp_extract(a, '[^/]*$')), ', ') ELSE 'none' END AS provenance FROM gated)"""
