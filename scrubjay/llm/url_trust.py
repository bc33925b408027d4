"""URL filter: allow and block rules, and link-graph propagation for what no rule judges.

Rules are looked up by joins, so there may be any number of them: a url's host gives its suffixes, those that have rules give the
lengths of their paths, and the url's prefixes of these lengths meet the rules by equality. Of the rules that fit, the longest
wins; of equally long ones a block.

Hosts are nodes, and an edge goes from the host of a page to each other host that the page links to. Trust is a personalised
PageRank that starts from trusted hosts and follows links; distrust starts from blocked hosts and runs against them, so a
host that links to bad ones is distrusted. A host is a seed if rules give at least `seed_share` of its pages that verdict, or, where
only links tell of it, its front page. Every seed starts with the same mass, of either kind, so both are on one scale, and
mass that ends at hosts without links on returns to the seeds. What no rule judges is blocked if distrust is more than `threshold` of its
host's trust and distrust together, else allowed.

DataFrame expressions only. The edge table is made once, distinct and without loops, and stored; each round joins it with
the scores (one row a host) and sums by host, which combines before the shuffle. A busy host's edges are dealt anew by the adaptive skew
join. Rounds are stored in the shared folder every few rounds, which cuts lineage.

Defined cases: a null url, or one without ://, has an empty host and path, matches no rule and is no node; null html has
no links; rules without host or path are ignored, repeated ones count once; repeated rows are judged each; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import removed, scratch, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules given as a list become literals up to this number, else rows of a table.
LITERALS = 500


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


class Settings(NamedTuple):
    damping: float = 0.85
    rounds: int = 16
    seed_share: float = 0.5
    #: A host with more distrust than this share of its trust and distrust is blocked.
    threshold: float = 0.5
    store_every: int = 4


HOST = "(?s)^.*?://([^/?#]*)"
PATH = "(?s)^.*?://[^/?#]*([^?#]*)"
#: Hosts in href attributes that name one.
LINK = "(?i)\\bhref\\s*=\\s*[\"']?\\s*(?:[a-z][a-z0-9+.\\-]*:)?//([^/?#\"'\\s>]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def longest_first(rules: list[Rule]) -> list[Rule]:
    """The order in which the first rule that fits wins."""
    return sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text))


def rule_table(spark: SparkSession, rules: list[Rule] | DataFrame, folder: str) -> DataFrame:
    """(rule_host, rule_path, allows), once a host and path, stored. rules: a list, or a table (verdict, host, path)."""
    if isinstance(rules, DataFrame):
        rows = rules.select("verdict", "host", "path")
    elif len(rules) > LITERALS:
        rows = spark.createDataFrame(rules, "verdict string, host string, path string")
    else:
        kind = "array<struct<verdict:string,host:string,path:string>>"
        rows = spark.range(1).select(F.explode(F.array(*(F.struct(*map(F.lit, r)) for r in rules)).cast(kind)).alias("r")).select("r.*")
    rows = rows.where("verdict IS NOT NULL AND host IS NOT NULL AND path IS NOT NULL")
    return stored(rows.groupBy(F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).agg(F.min((F.col("verdict") != "block").cast("int")).alias("allows")), f"{folder}/rules")


def ruled(urls: DataFrame, rules: DataFrame, folder: str) -> DataFrame:
    """(of_host, of_path, rule, by_rule) of the rows (host, path) that a rule fits, each once."""
    most = rules.agg(F.max(F.size(F.split("rule_host", "[.]")))).first()[0] or 0  # labels of a rule's host, one number
    lengths = stored(rules.groupBy(F.col("rule_host").alias("suffix")).agg(F.collect_set(F.length("rule_path")).alias("lengths")), f"{folder}/lengths")
    urls = urls.where("host <> ''").select("host", "path").distinct()
    labels = F.least(F.size(F.split("host", "[.]")), F.lit(most))
    suffixes = F.array_distinct(F.transform(F.sequence(F.lit(1), labels), lambda k: F.array_join(F.slice(F.split("host", "[.]"), -k, k), ".")))
    hosts = urls.select("host").distinct().select(F.col("host").alias("of_host"), F.explode(F.when(labels > 0, suffixes)).alias("suffix"))
    hosts = stored(hosts.join(lengths, "suffix").select("of_host", "suffix", "lengths"), f"{folder}/hosts")
    tried = urls.join(hosts, F.col("host") == F.col("of_host")).select("host", "path", "suffix", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    tried = tried.select("host", "path", "suffix", F.left("path", F.col("n")).alias("prefix"))
    fits = tried.join(rules, (F.col("suffix") == F.col("rule_host")) & (F.col("prefix") == F.col("rule_path")))
    text = F.concat("rule_host", "rule_path")
    best = fits.groupBy(F.col("host").alias("of_host"), F.col("path").alias("of_path")).agg(F.min(F.struct((-F.length(text)).alias("shorter"), "allows", text.alias("rule"))).alias("best"))
    return best.select("of_host", "of_path", F.col("best.rule").alias("rule"), F.when(F.col("best.allows") == 1, "allow").otherwise("block").alias("by_rule"))


def host_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """Distinct (src, dst) hosts of links between different hosts."""
    links = pages.where(F.contains(F.col(html_col), F.lit("//"))).select(host_of(F.col(url_col)).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1)))).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    return links.where("src <> '' AND dst <> '' AND src <> dst").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, mass: float, settings: Settings, folder: str) -> DataFrame:
    """(host, score): personalised PageRank over (src, dst) edges from seeds (host), each with `mass`.

    To return what dangling hosts lose to the seeds only scales all scores, so they are scaled once, to the seeds' mass.
    """
    degree = edges.groupBy(F.col("src").alias("of")).agg(F.count(F.lit(1)).alias("degree"))
    shares = stored(edges.join(degree, F.col("src") == F.col("of")).select("src", "dst", (1 / F.col("degree")).alias("share")), f"{folder}/shares")
    start = stored(seeds.select("host", F.lit((1 - settings.damping) * mass).alias("score")), f"{folder}/start")
    scores = start
    for k in range(1, settings.rounds + 1):
        flow = shares.join(scores, shares["src"] == scores["host"]).select(F.col("dst").alias("host"), (settings.damping * F.col("share") * F.col("score")).alias("score"))
        scores = flow.unionByName(start).groupBy("host").agg(F.sum("score").alias("score"))
        if k % settings.store_every == 0 or k == settings.rounds:
            scores = stored(scores, f"{folder}/scores-{k}")
    held, whole = scores.agg(F.sum("score")).first()[0], start.count() * mass  # two numbers
    return scores.select("host", (F.col("score") * (whole / held if held else 0.0)).alias("score"))


def host_scores(verdicts: DataFrame, edges: DataFrame, settings: Settings, folder: str) -> DataFrame:
    """(host, trust, distrust) of every host that a seed reaches. verdicts: (host, pages, allow, block), counts of a host's pages."""
    share = lambda verdict: F.col(verdict) >= settings.seed_share * F.col("pages")
    seeds = {"trust": verdicts.where(share("allow")).select("host"), "distrust": verdicts.where(share("block")).select("host")}
    count = verdicts.where(share("allow")).count() + verdicts.where(share("block")).count()
    mass = 1 / max(1, count)
    linked = not edges.isEmpty()
    out = {}
    for kind, hosts in seeds.items():
        if linked:
            way = edges if kind == "trust" else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            out[kind] = propagate(way, hosts, mass, settings, f"{folder}/{kind}")
        else:  # without edges all mass returns to the seeds
            out[kind] = hosts.select("host", F.lit(mass).alias("score"))
    both = out["trust"].select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(out["distrust"].select("host", F.lit(0.0).alias("trust"), F.col("score").alias("distrust")))
    return both.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))


def judge(spark: SparkSession, pages: DataFrame, rules: list[Rule] | DataFrame, settings: Settings = Settings(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, host, path, rule, verdict, trust and distrust of every row."""
    folder = scratch(spark, "trust")
    url = F.col(url_col)
    edges = stored(host_edges(pages, url_col, html_col), f"{folder}/edges")
    rows = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    urls = rows.select("host", "path").unionByName(ends.select("host", F.lit("/").alias("path")))
    found = stored(ruled(urls, rule_table(spark, rules, folder), folder), f"{folder}/found")

    judged = rows.select("host", "path", F.lit(1).alias("page")).unionByName(ends.select("host", F.lit("/").alias("path"), F.lit(0).alias("page"))).where("host <> ''")
    judged = judged.groupBy("host", "path").agg(F.sum("page").alias("pages"))
    judged = judged.join(found, (F.col("host") == F.col("of_host")) & (F.col("path") == F.col("of_path")), "left")
    front = (F.col("pages") == 0).cast("int")
    sums = [F.sum("pages").alias("pages"), *(F.sum(F.when(F.col("by_rule") == v, F.col("pages")).otherwise(0)).alias(v) for v in ("allow", "block")), *(F.max(F.when(F.col("by_rule") == v, front).otherwise(0)).alias(f"front_{v}") for v in ("allow", "block"))]
    verdicts = judged.groupBy("host").agg(*sums)
    crawled = F.col("pages") > 0
    verdicts = verdicts.select("host", F.greatest("pages", F.lit(1)).alias("pages"), *(F.when(crawled, F.col(v)).otherwise(F.col(f"front_{v}")).alias(v) for v in ("allow", "block")))
    verdicts = stored(verdicts, f"{folder}/verdicts")
    scores = stored(host_scores(verdicts, edges, settings, folder), f"{folder}/scores")

    scored = rows.join(scores.withColumnRenamed("host", "scored"), F.col("host") == F.col("scored"), "left")
    scored = scored.join(found, (F.col("host") == F.col("of_host")) & (F.col("path") == F.col("of_path")), "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_links = F.when(distrust > settings.threshold * (trust + distrust), "block").otherwise("allow")
    out = stored(scored.select(id_col, "host", "path", "rule", F.coalesce("by_rule", by_links).alias("verdict"), trust.alias("trust"), distrust.alias("distrust")), f"{folder}/out")
    removed(spark, *(f"{folder}/{x}" for x in ("edges", "rules", "lengths", "hosts", "found", "verdicts", "trust", "distrust", "scores")))
    return out
