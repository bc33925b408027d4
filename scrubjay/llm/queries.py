"""The queries of the training-data operators, one an operator, each over its whole table, and their SQL where SQL can tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, html_density, langid, media_tar, minhash, packing, robust_outliers, url_trust, warc
from .shared import removed, scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = scratch(spark, "warc")
    manifest, files = warc.archive(spark, pages, folder)
    removed(spark, f"{folder}/whole")
    rows = warc.read_indexed(manifest, files, with_payload=False)
    id_type = dict(pages.dtypes)["page_id"]
    return rows.select(F.col("record_id").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type).alias("refers_to"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = bpe.Vocabulary(tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    tokens = bpe.encode(table(spark, sf_dir, "documents"), vocabulary).withColumns({"n_tokens": (F.octet_length("ids") / 4).cast("long"), "ids_sha256": F.sha2("ids", 256)})
    # The digest columns travel with the row's id through decoding.
    tokens = tokens.select(F.struct("doc_id", "n_tokens", "ids_sha256").alias("row"), "ids")
    raw = bpe.decode(tokens, vocabulary, id_col="row")
    return raw.select("row.doc_id", "row.n_tokens", "row.ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


def op3_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


RULES = [url_trust.Rule("block", "net", "/"), url_trust.Rule("allow", "example.net", "/en/"), url_trust.Rule("block", "example.com", "/de/"), url_trust.Rule("allow", "org", "/fr/")]


def op4_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge(spark, table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


#: The pages table has no links between hosts. So that propagation has something to do, its pages get hosts and links by their ids.
LINKED_HOSTS = 61
LINKED_HOST = "concat('h', {h}, '.', CASE {h} % 7 WHEN 0 THEN 'net' WHEN 1 THEN 'example.net' WHEN 2 THEN 'org' ELSE 'info' END)"
LINKED_PAGES = (
    f"SELECT page_id, concat('http://', {LINKED_HOST.format(h=f'(page_id % {LINKED_HOSTS})')}, CASE WHEN page_id % 3 = 0 THEN '/en/a' ELSE '/fr/b' END) AS url, "
    "concat(" + ", ".join(f"'<a href=\"//', {LINKED_HOST.format(h=f'((page_id * page_id * {k} + page_id + {k}) % {LINKED_HOSTS + 9})')}, '/\">'" for k in (1, 3)) + ") AS html FROM pages"
)


def url_trust_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4 over the same pages with hosts and links of a generated graph, some of whose hosts have no page."""
    table(spark, sf_dir, "pages").createOrReplaceTempView("scrubjay_pages")
    rows = spark.sql(LINKED_PAGES.replace("FROM pages", "FROM scrubjay_pages"))
    return url_trust.judge(spark, rows, RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_ffd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), packing.Settings(tokenizer_path("word_bpe_49k.json")))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


#: Documents whose remainder of crc32(doc_id) is 0 are held out.
FOLDS = 5


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def op6_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out(F.col("doc_id"))))
    return langid.predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is the chosen side; the rejected one says its last assistant turn backwards."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    last = turns.where("role = 'assistant'").groupBy(F.col("conv_id").alias("of")).agg(F.max("turn").alias("last"))
    other = turns.join(last, F.col("conv_id") == F.col("of"), "left").select("conv_id", "turn", "role", F.when(F.col("turn") == F.col("last"), F.reverse("text")).otherwise(F.col("text")).alias("text"))
    sides = turns.withColumn("side", F.lit(chat_format.CHOSEN)).unionByName(other.withColumn("side", F.lit(chat_format.REJECTED)))
    return chat_format.segments(sides, pair_col="conv_id")


def op8_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_outliers.judge(spark, table(spark, sf_dir, "documents")).drop("distance2")


#: The query's contract takes four-word shingles; the operator's standard is five.
NEAR = minhash.Settings(shingle=4)


def op9_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.classes(spark, table(spark, sf_dir, "documents"), NEAR)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op10_tar_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media_tar.media_columns(table(spark, sf_dir, "documents"), scratch(spark, "media"))
    feature = F.format_string("png %dx%d, %d bits, %d bytes, begins %s", "width", "height", "bits", "payload_bytes", "first_samples")
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_warc_members, op2_byte_bpe, op3_text_density, op4_url_trust, url_trust_links, op5_ffd_packing, op6_crf_language, op7_preference_chat, op8_mcd_quality, op9_bbit_minhash, op10_tar_media)}


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def op1_sql() -> str:
    # Base32 by five hexadecimal digits, 20 bits, at a time.
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    groups = " || ".join(f"substr({letters}, 1 + ((v[{k + 1}] >> {s}) & 31)::INT, 1)" for k in range(8) for s in (15, 10, 5, 0))
    return f"""
WITH rows AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS h FROM pages),
parts AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, h,
  list_transform(range(8), lambda k: ('0x' || substr(h, 1 + 5 * k::INT, 5))::BIGINT) AS v, max(page_id) OVER (PARTITION BY h) AS response FROM rows)
SELECT page_id, payload_bytes, {groups} AS payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to FROM parts"""


def op4_sql(settings: url_trust.Settings = url_trust.Settings(), pages: str = "pages") -> str:
    host = lambda x: f"translate(coalesce(regexp_extract({x}, '^.*?://([^/?#]*)', 1, 's'), ''), '{url_trust.UPPER}', '{url_trust.LOWER}')"

    def case(value: str) -> str:
        whens = " ".join(f"WHEN (host = {sql_text(r.host)} OR ends_with(host, {sql_text('.' + r.host)})) AND starts_with(path, {sql_text(r.path)}) THEN {sql_text(getattr(r, value))}" for r in url_trust.longest_first(RULES))
        return f"CASE {whens} END"

    steps = []
    for kind, verdict, src, dst in (("trust", "allow", "src", "dst"), ("distrust", "block", "dst", "src")):
        steps.append(f"{kind}_edges AS (SELECT {src} AS src, {dst} AS dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY {src}) AS share FROM edges)")
        steps.append(f"{kind}_start AS (SELECT host, {1 - settings.damping}::DOUBLE * mass AS score FROM shares, masses WHERE {verdict} >= {settings.seed_share})")
        for k in range(1, settings.rounds + 1):
            before = f"{kind}_{k - 1}" if k > 1 else f"{kind}_start"
            steps.append(f"{kind}_{k} AS MATERIALIZED (SELECT host, sum(score) AS score FROM (SELECT e.dst AS host, {settings.damping}::DOUBLE * e.share * s.score AS score FROM {kind}_edges e JOIN {before} s ON e.src = s.host UNION ALL SELECT host, score FROM {kind}_start) GROUP BY host)")
        steps.append(f"{kind} AS (SELECT host, score * (SELECT count(*) * any_value(mass) FROM {kind}_start, masses) / sum(score) OVER () AS score FROM {kind}_{settings.rounds})")
    return f"""
WITH given AS (SELECT page_id, url, html FROM {pages}),
rows AS (SELECT page_id, html, {host('url')} AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM given),
ruled AS (SELECT page_id, host, path, {case('text')} AS rule, {case('verdict')} AS by_rule FROM rows),
links AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*["'']?\\s*(?:[a-z][a-z0-9+.\\-]*:)?//([^/?#"''\\s>]+)', 1)), '{url_trust.UPPER}', '{url_trust.LOWER}') AS dst FROM rows),
edges AS MATERIALIZED (SELECT DISTINCT src, dst FROM links WHERE src <> '' AND dst <> '' AND src <> dst),
uncrawled AS (SELECT DISTINCT dst AS host, '/' AS path FROM edges WHERE dst NOT IN (SELECT host FROM rows)),
shown AS (SELECT host, by_rule FROM ruled UNION ALL SELECT host, {case('verdict')} FROM uncrawled),
shares AS MATERIALIZED (SELECT host, avg(CASE WHEN by_rule = 'allow' THEN 1.0 ELSE 0.0 END) AS allow, avg(CASE WHEN by_rule = 'block' THEN 1.0 ELSE 0.0 END) AS block FROM shown WHERE host <> '' GROUP BY host),
masses AS MATERIALIZED (SELECT 1.0::DOUBLE / greatest(1, count(*) FILTER (allow >= {settings.seed_share}) + count(*) FILTER (block >= {settings.seed_share})) AS mass FROM shares),
{', '.join(steps)}
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.by_rule, CASE WHEN coalesce(d.score, 0) > {settings.threshold} * (coalesce(t.score, 0) + coalesce(d.score, 0)) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN trust t ON r.host = t.host LEFT JOIN distrust d ON r.host = d.host"""


OP7_SQL = """
WITH last AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
turns AS (SELECT DISTINCT c.conv_id, c.turn, side, struct_pack(r := coalesce(c.role, ''), t := coalesce(CASE WHEN side = 'rejected' AND c.turn = l.last THEN reverse(c.text) ELSE c.text END, '')) AS said
  FROM conversations c CROSS JOIN (VALUES ('chosen'), ('rejected')) sides(side) LEFT JOIN last l ON c.conv_id = l.conv_id WHERE c.conv_id IS NOT NULL AND c.turn IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, side, turn ORDER BY said) AS repeat FROM turns),
both_sides AS (SELECT conv_id, turn, repeat, min(said) FILTER (side = 'chosen') AS chosen, min(said) FILTER (side = 'rejected') AS rejected FROM numbered GROUP BY conv_id, turn, repeat),
firsts AS (SELECT conv_id, min(struct_pack(t := turn, k := repeat)) AS first FROM both_sides WHERE chosen IS DISTINCT FROM rejected GROUP BY conv_id),
parted AS (SELECT b.*, f.first IS NULL OR struct_pack(t := b.turn, k := b.repeat) < f.first AS common FROM both_sides b LEFT JOIN firsts f ON b.conv_id = f.conv_id),
parts AS (SELECT conv_id, turn, repeat, 'prompt' AS part, chosen AS said FROM parted WHERE common
  UNION ALL SELECT conv_id, turn, repeat, 'chosen', chosen FROM parted WHERE NOT common UNION ALL SELECT conv_id, turn, repeat, 'rejected', rejected FROM parted WHERE NOT common)
SELECT conv_id, part, turn, repeat::INT AS repeat, '<|' || said.r || '|>' || chr(10) AS opening, said.t || '<|end|>' || chr(10) AS body, (part <> 'prompt' AND said.r = 'assistant')::INT AS mask FROM parts"""

OP9_SQL = """
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [md5(array_to_string(w, ' '))] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: md5(array_to_string(w[i:i + 3], ' ')))) END AS s FROM words),
distinct_sets AS MATERIALIZED (SELECT min(doc_id) AS node, s, md5(array_to_string(list_sort(s), ' ')) AS digest FROM sets WHERE len(s) > 0 GROUP BY s, digest),
nodes AS MATERIALIZED (SELECT min(node) AS node, any_value(s) AS s, digest FROM distinct_sets GROUP BY digest),
items AS MATERIALIZED (SELECT node, len(s) AS n, unnest(s) AS x FROM nodes),
pairs AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM items a JOIN items b ON a.x = b.x AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT node AS a, node AS b FROM nodes WHERE node IN (SELECT a FROM edges) UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
named AS (SELECT a AS node, min(b) AS class FROM reach GROUP BY a)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(c.class, n.node, d.doc_id) AS component_id, d.doc_id = coalesce(c.class, n.node, d.doc_id) AS kept
FROM sets d LEFT JOIN nodes n ON len(d.s) > 0 AND md5(array_to_string(list_sort(d.s), ' ')) = n.digest LEFT JOIN named c ON n.node = c.node"""


def op8_sql(settings: robust_outliers.Settings = robust_outliers.Settings()) -> str:
    """The whole estimate step by step: a CTE a concentration step, all starts side by side. Steps past the end change nothing."""
    parts, pairs = range(len(robust_outliers.PARTS)), robust_outliers.pairs()
    floor2 = [f ** 2 for f in settings.floors]
    floor = lambda i, j: f" + {floor2[i]!r}::DOUBLE" if i == j else ""
    factors = []
    for i, j in pairs:
        rest = f"s{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        factors.append(f"sqrt(greatest({rest}, 1e-9)) AS l{i}{i}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    zs = ", ".join(f"(x{i} - m{i}" + "".join(f" - l{i}{j} * z{j}" for j in range(i)) + f") / l{i}{i} AS z{i}" for i in parts)
    far = " + ".join(f"z{i} * z{i}" for i in parts)
    factored = lambda name: f"(SELECT *, {', '.join(factors)} FROM {name})"
    xs, ms, ss = ", ".join(f"x{i}" for i in parts), ", ".join(f"m{i}" for i in parts), ", ".join(f"s{i}{j}" for i, j in pairs)

    def medians(name: str, values: list[str], source: str) -> str:
        binned = " UNION ALL ".join(f"SELECT pool, {i} AS part, floor({v} * {robust_outliers.GRID} + 0.5) AS bin FROM {source}" for i, v in enumerate(values))
        return f"""{name}_bins AS (SELECT pool, part, bin, count(*) AS n FROM ({binned}) GROUP BY ALL),
{name}_half AS (SELECT *, sum(n) OVER (PARTITION BY pool, part ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY pool, part) AS whole FROM {name}_bins),
{name} AS MATERIALIZED (SELECT pool, {', '.join(f"min(bin) FILTER (part = {i}) / {robust_outliers.GRID} AS m{i}" for i in parts)} FROM {name}_half WHERE 2 * upto >= whole GROUP BY pool)"""

    cov = lambda a, i, j: f"({a}{i}{j} / n - {a}{i} / n * {a}{j} / n)"
    kinds = [
        (lambda i: f"m{i}", lambda i, j: f"d{i} * d{j}" if i == j else "0.0::DOUBLE"),
        (lambda i: f"t{i} / n", lambda i, j: cov("t", i, j) + floor(i, j)),
        (lambda i: f"m{i}", lambda i, j: f"d{i} * d{j}" + ("" if i == j else f" * 0.99 * {cov('g', i, j)} / sqrt(greatest({cov('g', i, i)} * {cov('g', j, j)}, 1e-18))")),
        (lambda i: f"m{i}", lambda i, j: f"d{i} * d{j} * 4 * u{i}{j} / n" + floor(i, j)),
    ]
    sums = [f"sum(x{i}) AS t{i}, sum(tanh(z{i})) AS g{i}, max(m{i}) AS m{i}, max(d{i}) AS d{i}" for i in parts]
    sums += [f"sum(x{i} * x{j}) AS t{i}{j}, sum(tanh(z{i}) * tanh(z{j})) AS g{i}{j}, sum(z{i} * z{j} / greatest({far}, 1e-12)) AS u{i}{j}" for i, j in pairs]
    steps = [
        medians("medians", [f"x{i}" for i in parts], "vectors"),
        medians("spreads", [f"abs(x{i} - m{i})" for i in parts], "(SELECT * FROM vectors JOIN medians USING (pool))"),
        f"base AS (SELECT m.*, {', '.join(f'sqrt(pow(1.4826 * s.m{i}, 2) + {floor2[i]!r}::DOUBLE) AS d{i}' for i in parts)} FROM medians m JOIN spreads s ON m.pool = s.pool)",
        f"standard AS (SELECT *, {', '.join(f'(x{i} - m{i}) / d{i} AS z{i}' for i in parts)} FROM vectors JOIN base USING (pool))",
        f"sums AS MATERIALIZED (SELECT pool, count(*)::DOUBLE AS n, {', '.join(sums)} FROM standard GROUP BY pool)",
        "step0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT pool, {k} AS start, {', '.join(f'{m(i)} AS m{i}' for i in parts)}, {', '.join(f'{sc(i, j)} AS s{i}{j}' for i, j in pairs)} FROM sums" for k, (m, sc) in enumerate(kinds)) + ")",
    ]
    for k in range(1, settings.steps + 1):
        scatter = ", ".join(f"{settings.consistency!r}::DOUBLE * (t{i}{j} / n - m{i} * m{j}){floor(i, j)} AS s{i}{j}" for i, j in pairs)
        steps += [
            f"near{k} AS (SELECT v.pool, start, {xs}, {zs}, floor({robust_outliers.DOUBLING} * log2({far} + 1e-6)) AS bin FROM vectors v JOIN {factored(f'step{k - 1}')} e ON v.pool = e.pool)",
            f"bins{k} AS (SELECT pool, start, bin, count(*) AS n, {', '.join(f'sum(x{i}) AS t{i}' for i in parts)}, {', '.join(f'sum(x{i} * x{j}) AS t{i}{j}' for i, j in pairs)} FROM near{k} GROUP BY pool, start, bin)",
            f"inner{k} AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY pool, start ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY pool, start) AS whole FROM bins{k})",
            f"sums{k} AS (SELECT pool, start, sum(n)::DOUBLE AS n, {', '.join(f'sum(t{i}) AS t{i}' for i in parts)}, {', '.join(f'sum(t{i}{j}) AS t{i}{j}' for i, j in pairs)} FROM inner{k} WHERE before < {settings.share} * whole GROUP BY pool, start)",
            f"step{k} AS MATERIALIZED (SELECT pool, start, {', '.join(f't{i} / n AS m{i}' for i in parts)}, {scatter} FROM sums{k})",
        ]
    steps.append(f"best AS MATERIALIZED (SELECT pool, {ms}, {ss} FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY round({' + '.join(f'2 * ln(l{i}{i})' for i in parts)}, 9), start) AS place FROM {factored(f'step{settings.steps}')}) WHERE place = 1)")
    return f"""
WITH texts AS (SELECT doc_id, coalesce(lang, chr(1)) AS lang_key, coalesce(source, chr(1)) AS source_key, coalesce(text, '') AS t FROM documents),
split AS MATERIALIZED (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM texts),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM split),
often AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows),
nexts AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i AS gap FROM often WHERE n > 1),
repeats AS (SELECT doc_id, sum(least(3, coalesce(gap, 3)))::BIGINT AS n_repeat_words FROM nexts GROUP BY doc_id),
counts AS (SELECT s.doc_id, lang_key, source_key, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM split s LEFT JOIN repeats r ON s.doc_id = r.doc_id),
rows AS MATERIALIZED (SELECT *, n_words < {settings.fewest_words} OR 100 * n_repeat_words > {settings.repeat_percent} * n_words AS base_failed, ln(greatest(word_chars::DOUBLE / greatest(n_words, 1), 0.1)) AS x0, sqrt(n_symbols::DOUBLE / greatest(word_chars, 1)) AS x1,
  sqrt(n_dup_lines::DOUBLE / greatest(n_words, 1)) AS x2, sqrt(n_repeat_words::DOUBLE / greatest(n_words, 1)) AS x3 FROM counts),
sizes AS (SELECT lang_key, source_key, count(*) FILTER (NOT base_failed) AS n FROM rows GROUP BY ALL),
small AS (SELECT lang_key, sum(n) AS pooled FROM sizes WHERE n < {settings.least} GROUP BY lang_key),
keys AS (SELECT z.lang_key, z.source_key, CASE WHEN z.n >= {settings.least} THEN 'group ' || z.lang_key || ' ' || z.source_key WHEN s.pooled >= {settings.least} THEN 'language ' || z.lang_key ELSE 'all' END AS pool FROM sizes z LEFT JOIN small s ON z.lang_key = s.lang_key),
pooled AS MATERIALIZED (SELECT r.*, k.pool FROM rows r JOIN keys k ON r.lang_key = k.lang_key AND r.source_key = k.source_key),
vectors AS MATERIALIZED (SELECT pool, {xs} FROM pooled WHERE NOT base_failed),
{", ".join(steps)},
judged AS (SELECT p.*, {zs}, {far} AS far FROM pooled p LEFT JOIN {factored("best")} e ON p.pool = e.pool)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(far <= {settings.limit}, true) AS kept FROM judged"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_members": op1_sql(), "op4_url_trust": op4_sql(), "url_trust_links": op4_sql(pages=f"({LINKED_PAGES})"), "op7_preference_chat": OP7_SQL, "op8_mcd_quality": op8_sql(), "op9_bbit_minhash": OP9_SQL}
