"""Quality rules: robust multivariate outliers among text statistics, by language and source.

Each text gives counts of words, symbols, repeated lines and repeated word windows. Base rules reject what is short or
mostly repetition. The others' statistics, transformed, form a vector; each language and source gets a minimum-covariance-determinant
estimate of its location and scatter, and a text is rejected if its squared Mahalanobis distance exceeds `limit`.

The estimate is the subset of `share` of a group's texts whose scatter has the least determinant. Concentration steps find it: take
the distances from an estimate, the share of texts with the least of them, their mean and covariance, again until no
determinant changes; no step raises one. They run from four deterministic starts (medians and median deviations; mean and covariance of all; the
correlation of the standardised values' hyperbolic tangents; that of their directions alone), and of what the starts end in, the least
determinant wins. A step is one aggregation: texts are summed by group, start and bin of distance, which combines before the shuffle; the
bins of a group, some hundreds at most whatever its size, then tell where the share ends. A bin is about a hundredth of the distance
wide, and is taken whole. Scatter gets the consistency factor of its share and a floor on each variance (a regularised
determinant), for most texts have no symbol or repetition at all. Groups of fewer than `least` texts are pooled by language, and languages
still too small pool all.

Estimates are joined to texts by a broadcast only up to `MOST_BROADCAST` groups; beyond, by a join whose hot keys the adaptive
skew join can split.

DataFrame functions only. A whole text is handled inside its row, so no group of texts or words is ever collected.

Defined cases: a null text has no words and fails the base rules; a null language or source is a group of its own; a
group without spread has the floors' scatter; repeated rows are judged each alike; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import SPACE_PATTERN, WORD_PATTERN, removed, scratch, stored


#: Groups whose estimates are sent to every task: some hundred bytes each for every start.
MOST_BROADCAST = 20_000


class Settings(NamedTuple):
    fewest_words: int = 50
    repeat_percent: int = 50
    share: float = 0.75
    steps: int = 12
    least: int = 100
    #: Of the vector's parts in order: standard deviations that any group is granted.
    floors: tuple[float, ...] = (0.10, 0.05, 0.08, 0.12)
    #: The chi-square quantile of four degrees of freedom at 1 - 1e-6.
    limit: float = 33.4

    @property
    def consistency(self) -> float:
        """What makes the covariance of the inner share of a normal sample of four dimensions that of the whole."""
        if self.share >= 1:
            return 1.0
        low, high = 0.0, 400.0
        for _ in range(200):  # the share's quantile of chi-square with four degrees of freedom
            middle = (low + high) / 2
            low, high = (middle, high) if 1 - math.exp(-middle / 2) * (1 + middle / 2) < self.share else (low, middle)
        return self.share / (1 - math.exp(-low / 2) * (1 + low / 2 + low * low / 8))


PARTS = ("x0", "x1", "x2", "x3")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that the text has twice or more. Windows are told apart by 64-bit hashes."""

    def covered(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda x, j: (F.get(ordered, j - 1)["h"] == x["h"]) | (F.get(ordered, j + 1)["h"] == x["h"]))
        places = F.array_sort(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("sum"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["sum"] + F.least(F.lit(3), i - acc["last"])).cast("long").alias("sum"))
        return F.aggregate(places, start, step, lambda acc: acc["sum"])

    def windows(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(ordered, covered))

    hashes = F.transform(F.sequence(F.lit(2), F.size(words) - 1), lambda i: F.xxhash64(F.get(words, i - 2), F.get(words, i - 1), F.get(words, i)))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(hashes, windows))


def statistics(text: Column) -> Column:
    """Struct of the counts of one text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_PATTERN))
    dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    of_words = let(
        F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0)),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"), repeated_words(w).alias("n_repeat_words")),
    )
    return let(of_words, lambda s: F.struct(s["n_words"].alias("n_words"), s["word_chars"].alias("word_chars"), F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), dup_lines.cast("long").alias("n_dup_lines"), s["n_repeat_words"].alias("n_repeat_words")))


def base_failed(settings: Settings) -> Column:
    return (F.col("n_words") < settings.fewest_words) | (100 * F.col("n_repeat_words") > settings.repeat_percent * F.col("n_words"))


def vector() -> dict[str, Column]:
    """Transformed statistics: mean word length, and shares of symbols, repeated lines and repeated words."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "x0": F.log(F.greatest(F.col("word_chars").cast("double") / words, F.lit(0.1))),
        "x1": F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "x2": F.sqrt(F.col("n_dup_lines") / words),
        "x3": F.sqrt(F.col("n_repeat_words") / words),
    }


def with_statistics(docs: DataFrame, settings: Settings, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """All rows and columns of docs, and: lang_key, source_key, the counts, base_failed, the vector."""
    out = docs.withColumns({"lang_key": F.coalesce(F.col(lang_col).cast("string"), F.lit("\x00")), "source_key": F.coalesce(F.col(source_col).cast("string"), F.lit("\x00")), "stats": statistics(F.col(text_col))})
    out = out.withColumns({c: F.col("stats")[c] for c in COUNTS}).drop("stats")
    return out.withColumn("base_failed", base_failed(settings)).withColumns(vector())


def pooled_keys(rows: DataFrame, settings: Settings) -> DataFrame:
    """(lang_of, source_of, pool) for every language and source: the group itself, its language's small ones, or all such."""
    sizes = rows.groupBy("lang_key", "source_key").agg(F.count_if(~F.col("base_failed")).alias("n"))
    own = F.col("n") >= settings.least
    small = sizes.where(~own).groupBy(F.col("lang_key").alias("small_lang")).agg(F.sum("n").alias("pooled"))
    joined = sizes.join(small, F.col("lang_key") == F.col("small_lang"), "left")
    pool = F.when(own, F.concat_ws("\x01", F.lit("group"), "lang_key", "source_key")).when(F.col("pooled") >= settings.least, F.concat_ws("\x01", F.lit("language"), "lang_key")).otherwise(F.lit("all"))
    return joined.select(F.col("lang_key").alias("lang_of"), F.col("source_key").alias("source_of"), pool.alias("pool"))


def distance(settings: Settings) -> Column:
    """Squared Mahalanobis distance from m0.. and the factor l00, l10, ... of a group's scatter, by forward substitution."""
    z: list[Column] = []
    for i in range(len(PARTS)):
        rest = F.col(PARTS[i]) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * z[j]
        z.append(rest / F.col(f"l{i}{i}"))
    return sum((x * x for x in z[1:]), z[0] * z[0])


def factored(estimates: DataFrame) -> DataFrame:
    """Adds the lower triangular factor of the scatter s00, s10, s11, ...: one column after the other, so none is repeated."""
    for i in range(len(PARTS)):
        for j in range(i + 1):
            rest = F.col(f"s{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            estimates = estimates.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    return estimates


def pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(PARTS)) for j in range(i + 1)]


#: Bins of the values among which medians are found, and of the distances' doublings.
GRID, DOUBLING = 256, 64


def few(groups: DataFrame) -> bool:
    return groups.count() <= MOST_BROADCAST


def with_estimates(rows: DataFrame, estimates: DataFrame, small: bool) -> DataFrame:
    """Rows (pool, ...) with the columns of estimates (pool, ...)."""
    table = estimates.withColumnRenamed("pool", "pool_of")
    return rows.join(F.broadcast(table) if small else table, F.col("pool") == F.col("pool_of")).drop("pool_of")


def summed(rows: DataFrame, keys: list[str], sums: list[Column], small: bool) -> DataFrame:
    """One row a key. Where rows came by a shuffle join, they are dealt anew by the key first, so that a hot pool's can be split before."""
    return (rows if small else rows.repartition(*keys)).groupBy(*keys).agg(*sums)


def medians(rows: DataFrame, values: list[Column], small: bool) -> DataFrame:
    """(pool, m0..): the medians of the values, to the nearest of GRID parts of one."""
    binned = rows.select("pool", F.posexplode(F.array(*values)).alias("part", "value")).select("pool", "part", F.floor(F.col("value") * GRID + 0.5).alias("bin"))
    bins = summed(binned, ["pool", "part", "bin"], [F.count(F.lit(1)).alias("n")], small)
    group = Window.partitionBy("pool", "part")
    half = bins.withColumns({"upto": F.sum("n").over(group.orderBy("bin")), "whole": F.sum("n").over(group)}).where("2 * upto >= whole")
    least = half.groupBy("pool", "part").agg((F.min("bin") / GRID).alias("median"))
    return least.groupBy("pool").agg(*(F.max(F.when(F.col("part") == i, F.col("median"))).alias(f"m{i}") for i in range(len(PARTS))))


def starts(rows: DataFrame, settings: Settings, folder: str, small: bool) -> DataFrame:
    """(pool, start, m0.., s00..): the four estimates that concentration starts from."""
    n = range(len(PARTS))
    middle = stored(medians(rows, [F.col(p) for p in PARTS], small), f"{folder}/medians")
    spread = medians(with_estimates(rows, middle, small), [F.abs(F.col(p) - F.col(f"m{i}")) for i, p in enumerate(PARTS)], small)
    spread = spread.select(F.col("pool").alias("pool_of"), *(F.sqrt(F.pow(1.4826 * F.col(f"m{i}"), 2) + settings.floors[i] ** 2).alias(f"d{i}") for i in n))
    base = stored(middle.join(spread, F.col("pool") == F.col("pool_of")).drop("pool_of"), f"{folder}/base")
    z = with_estimates(rows, base, small).withColumns({f"z{i}": (F.col(p) - F.col(f"m{i}")) / F.col(f"d{i}") for i, p in enumerate(PARTS)})
    z = z.withColumns({f"h{i}": F.tanh(f"z{i}") for i in n} | {"norm2": F.greatest(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in n[1:]), F.col("z0") * F.col("z0")), F.lit(1e-12))})
    sums = [F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"{a}{i}") for i in n for a, c in (("t", PARTS[i]), ("g", f"h{i}")))]
    sums += [F.sum(c).alias(f"{a}{i}{j}") for i, j in pairs() for a, c in (("t", F.col(PARTS[i]) * F.col(PARTS[j])), ("g", F.col(f"h{i}") * F.col(f"h{j}")), ("u", F.col(f"z{i}") * F.col(f"z{j}") / F.col("norm2")))]
    sums = [*sums, *(F.max(F.col(f"{a}{i}")).alias(f"{a}{i}") for i in n for a in "md")]
    z = summed(z, ["pool"], sums, small)
    floor2 = [f**2 for f in settings.floors]
    cov = lambda a, i, j: F.col(f"{a}{i}{j}") / F.col("n") - F.col(f"{a}{i}") / F.col("n") * F.col(f"{a}{j}") / F.col("n")
    both = lambda i, j: F.col(f"d{i}") * F.col(f"d{j}")
    # Off the diagonal a little less than found, so that every scatter is positive definite.
    tanh = lambda i, j: both(i, j) * 0.99 * F.coalesce(cov("g", i, j) / F.sqrt(F.greatest(cov("g", i, i) * cov("g", j, j), F.lit(1e-18))), F.lit(0.0))
    turned = lambda i, j: both(i, j) * len(PARTS) * F.col(f"u{i}{j}") / F.col("n")
    kinds = [
        (lambda i: F.col(f"m{i}"), lambda i, j: both(i, j) if i == j else F.lit(0.0)),
        (lambda i: F.col(f"t{i}") / F.col("n"), lambda i, j: cov("t", i, j) + (floor2[i] if i == j else 0.0)),
        (lambda i: F.col(f"m{i}"), lambda i, j: both(i, j) if i == j else tanh(i, j)),
        (lambda i: F.col(f"m{i}"), lambda i, j: turned(i, j) + (floor2[i] if i == j else 0.0)),
    ]
    rows_of = [F.struct(F.lit(k).alias("start"), *(m(i).alias(f"m{i}") for i in n), *(s(i, j).alias(f"s{i}{j}") for i, j in pairs())) for k, (m, s) in enumerate(kinds)]
    return z.select("pool", F.explode(F.array(*rows_of)).alias("e")).select("pool", "e.*")


def concentrated(rows: DataFrame, estimates: DataFrame, settings: Settings, small: bool = True) -> DataFrame:
    """One concentration step of each start: (pool, start, m0.., s00..) of each pool's share of rows with the least distances."""
    near = with_estimates(rows, factored(estimates), small).withColumn("bin", F.floor(DOUBLING * F.log2(distance(settings) + 1e-6)))
    sums = [F.count(F.lit(1)).alias("n"), *(F.sum(p).alias(f"t{i}") for i, p in enumerate(PARTS)), *(F.sum(F.col(PARTS[i]) * F.col(PARTS[j])).alias(f"t{i}{j}") for i, j in pairs())]
    bins = summed(near, ["pool", "start", "bin"], sums, small)
    group = Window.partitionBy("pool", "start")
    so_far = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    inner = bins.withColumns({"before": F.coalesce(F.sum("n").over(so_far), F.lit(0)), "whole": F.sum("n").over(group)}).where(F.col("before") < settings.share * F.col("whole"))
    names = [c for c in inner.columns if c[0] == "t" and c[1:].isdigit()]
    total = inner.groupBy("pool", "start").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names))
    total = total.withColumns({f"m{i}": F.col(f"t{i}") / F.col("n") for i in range(len(PARTS))})
    scatter = {f"s{i}{j}": settings.consistency * (F.col(f"t{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) + (settings.floors[i] ** 2 if i == j else 0.0) for i, j in pairs()}
    return total.withColumns(scatter).select("pool", "start", *(f"m{i}" for i in range(len(PARTS))), *scatter)


def log_determinant() -> Column:
    """Of the scatter whose factor is l00, l10, ..."""
    return sum((2 * F.log(f"l{i}{i}") for i in range(1, len(PARTS))), 2 * F.log("l00"))


def least_determinants(sample: DataFrame, settings: Settings, folder: str, small: bool) -> DataFrame:
    """(pool, m0.., s00..): for each pool of rows (pool, x0..), where the start with the least determinant ended."""
    estimates = stored(starts(sample, settings, folder, small).coalesce(1), f"{folder}/0")
    before = None
    for k in range(1, settings.steps + 1):
        estimates = stored(concentrated(sample, estimates, settings, small).coalesce(1), f"{folder}/{k}")
        # Converged when the sum of all determinants' logarithms, none of which a step raises, stays: one number to the driver.
        now = factored(estimates).agg(F.sum(log_determinant())).first()[0]
        if before is None or now is None or abs(now - before) > 1e-9 * max(1.0, abs(now)):
            before = now
        else:
            break
    columns = [*(f"m{i}" for i in range(len(PARTS))), *(f"s{i}{j}" for i, j in pairs())]
    best = factored(estimates).groupBy("pool").agg(F.min(F.struct(F.round(log_determinant(), 9).alias("d"), "start", *columns)).alias("e"))
    return best.select("pool", *(f"e.{c}" for c in columns))


def fit(rows: DataFrame, settings: Settings, folder: str) -> DataFrame:
    """(lang_of, source_of, m0.., l00..) for every language and source of rows (lang_key, source_key, base_failed, x0..)."""
    keys = stored(pooled_keys(rows, settings), f"{folder}/keys")
    small = few(keys)
    table = F.broadcast(keys) if small else keys
    sample = rows.where(~F.col("base_failed")).join(table, (F.col("lang_key") == F.col("lang_of")) & (F.col("source_key") == F.col("source_of"))).select("pool", *PARTS)
    sample = stored(sample, f"{folder}/vectors")
    found = factored(least_determinants(sample, settings, folder, small))
    return keys.join(F.broadcast(found) if small else found, "pool").drop("pool")


def judged(rows: DataFrame, estimates: DataFrame, settings: Settings) -> DataFrame:
    """Adds distance2 and kept. Sources that the estimates lack have only base rules against them."""
    table = F.broadcast(estimates) if few(estimates) else estimates
    joined = rows.join(table, (F.col("lang_key") == F.col("lang_of")) & (F.col("source_key") == F.col("source_of")), "left")
    far = distance(settings)
    return joined.withColumns({"distance2": far, "kept": ~F.col("base_failed") & F.coalesce(far <= settings.limit, F.lit(True))})


def judge(spark: SparkSession, docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id_col, the counts, base_failed, kept and distance2 of every row. Texts are read once."""
    folder = scratch(spark, "outliers")
    rows = with_statistics(docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("body"), F.col(lang_col).alias("lang_in"), F.col(source_col).alias("source_in")), settings, "body", "lang_in", "source_in")
    rows = stored(rows.select("row_id", "lang_key", "source_key", *COUNTS, "base_failed", *PARTS), f"{folder}/rows")
    estimates = stored(fit(rows, settings, f"{folder}/fit"), f"{folder}/estimates")
    out = stored(judged(rows, estimates, settings).select(F.col("row_id").alias(id_col), *COUNTS, "base_failed", "kept", "distance2"), f"{folder}/out")
    removed(spark, *(f"{folder}/{x}" for x in ("rows", "fit", "estimates")))
    return out


def keep(spark: SparkSession, docs: DataFrame, settings: Settings = Settings(), text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that are kept, with their columns.

    Statistics are counted once and stored beside the whole rows; the fit reads them alone, and the rows are
    filtered where they lie, so no text is counted twice or shuffled.
    """
    folder = scratch(spark, "outliers")
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    full = with_statistics(inner.select("row", F.col("row")[text_col].alias("body"), F.col("row")[lang_col].alias("lang_in"), F.col("row")[source_col].alias("source_in")), settings, "body", "lang_in", "source_in")
    rows = stored(full.select("row", "lang_key", "source_key", "base_failed", *PARTS), f"{folder}/rows")
    estimates = stored(fit(rows, settings, f"{folder}/fit"), f"{folder}/estimates")
    out = stored(judged(rows, estimates, settings).where("kept").select("row.*"), f"{folder}/out")
    removed(spark, *(f"{folder}/{x}" for x in ("rows", "fit", "estimates")))
    return out
