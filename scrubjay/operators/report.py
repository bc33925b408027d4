"""Reports over outcomes: (ord, path, disposition, prov, removals, preserved, written, error)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import provenance

# What a report shows of the things that were kept, and the remedy it names.
NOTABLE = ("C2PA", "/AF", "EmbeddedFiles", "verbatim", "licence header", "docstrip guard", "hidden")
NO_SAFE_EDIT = "nothing above was removed -- to drop it, re-export from the original and sign the result, rather than editing this file"
INDENT = " " * 9
SHOWN = 5


def removal_text(r: Column) -> Column:
    base = F.concat(r["where"], F.lit(": "), r["what"])
    return F.when(r["detail"] == "", base).otherwise(F.concat(base, F.lit(" ("), r["detail"], F.lit(")")))


def applied(removals: Column, yes: bool = True) -> Column:
    return F.filter(removals, lambda r: r["applied"] if yes else ~r["applied"])


def changed(removals: Column) -> Column:
    return F.exists(removals, lambda r: r["applied"])


def notable(preserved: Column) -> Column:
    return F.filter(preserved, lambda p: F.exists(F.array(*map(F.lit, NOTABLE)), lambda m: F.contains(p, m)))


def judged(outcomes: DataFrame) -> DataFrame:
    """Adds refused, reason, provenance (in words), attribution, present."""
    p = F.col("prov")
    return outcomes.withColumns({"refused": provenance.refused(F.col("disposition"), F.col("error")), "reason": provenance.reason(F.col("disposition"), F.col("error")), "provenance": provenance.describe(p), "attribution": provenance.attribution(p["signer"]), "present": provenance.present(p)})


def json_rows(outcomes: DataFrame) -> DataFrame:
    """(ord, json): the twelve entries of each outcome."""
    texts = lambda yes: F.transform(applied(F.col("removals"), yes), removal_text)
    entry = F.struct(F.col("path"), F.col("disposition"), F.col("refused"), F.col("reason"), F.col("provenance"), F.col("attribution"), F.col("prov")["signer"].alias("signer"), F.col("prov")["sidecars"].alias("sidecars"), texts(True).alias("removals"), texts(False).alias("found"), F.col("preserved"), F.col("written"))
    return judged(outcomes).select("ord", F.to_json(entry, {"ignoreNullFields": "false"}).alias("json"))


def lines_of(verbose: bool = True) -> Column:
    """The report's lines of one judged outcome."""
    line = lambda *parts: F.concat(F.lit(INDENT), *(F.lit(x) if isinstance(x, str) else x for x in parts))
    one = lambda condition, text: F.when(condition, F.array(text)).otherwise(F.array().cast("array<string>"))
    removals, n = F.col("removals"), F.size("removals")
    some = n > 0
    each = lambda rs, word: F.transform(rs, lambda r: F.concat(F.lit(INDENT), word, F.lit(": "), removal_text(r)))
    many = lambda word, count, rest="": F.concat(F.lit(INDENT), word, F.lit(" "), count.cast("string"), F.lit(" item(s)" + rest))
    found = each(removals, F.lit("found")) if verbose else one(some, many(F.lit("found"), n, " that would be removed if it were scrubbable"))
    refused = F.concat(
        F.array(F.concat(F.lit("REFUSED  "), F.col("path")), line(F.col("reason"))),
        one(F.col("attribution").isNotNull(), line("mark: ", F.col("attribution"))),
        one(F.col("present"), line("found: ", F.col("provenance"))),
        found,
        one(some, line(NO_SAFE_EDIT)),
    )
    verb = F.when(F.col("written").isNull(), "would remove").otherwise("removed")
    done, seen = applied(removals), applied(removals, False)
    body = F.concat(each(done, verb), each(seen, F.lit("found"))) if verbose else F.concat(one(F.size(done) > 0, many(verb, F.size(done))), one(F.size(seen) > 0, many(F.lit("found"), F.size(seen))))
    scrubbed = F.concat(
        F.array(F.concat(F.lit("OK       "), F.col("path"), F.coalesce(F.concat(F.lit(" -> "), F.col("written")), F.lit("")))),
        one(~some, line("nothing to remove")),
        body,
        F.transform(notable(F.col("preserved")), lambda p: F.concat(F.lit(INDENT + "preserved: "), p)),
    )
    return F.when(F.col("refused"), refused).otherwise(scrubbed)


def text_rows(outcomes: DataFrame, verbose: bool = True) -> DataFrame:
    """(ord, text): each outcome as the report shows it."""
    return judged(outcomes).select("ord", F.array_join(lines_of(verbose), "\n").alias("text"))


def footer(outcomes: DataFrame) -> DataFrame:
    """One row: total, refused, processed, exit_code and the closing line."""
    out = judged(outcomes).agg(F.count(F.lit(1)).alias("total"), F.count_if("refused").alias("refused"))
    out = out.withColumns({"processed": F.col("total") - F.col("refused"), "exit_code": (F.col("refused") > 0).cast("int")})
    return out.withColumn("line", F.concat(F.col("total").cast("string"), F.lit(" file(s), "), F.col("refused").cast("string"), F.lit(" refused, "), F.col("processed").cast("string"), F.lit(" processed")))


def removed_fields(removals: DataFrame) -> DataFrame:
    """(path, fields): the distinct names of what was removed, sorted."""
    return removals.where("applied").groupBy("path").agg(F.array_sort(F.collect_set("what")).alias("fields"))


def first_lines(rows: DataFrame, key: str, line: str, parts: int = 64) -> DataFrame:
    """(key, count, summary): how many lines, and the first few of them in order.

    A key's rows are dealt to `parts` first; each part keeps its own first few, so a key of any size meets as parts * SHOWN rows.
    """
    from pyspark.sql import Window

    dealt = rows.select(key, line).withColumn("part", F.pmod(F.xxhash64(line), F.lit(parts)))
    low = dealt.withColumn("rank", F.row_number().over(Window.partitionBy(key, "part").orderBy(line))).where(F.col("rank") <= SHOWN)
    first = low.groupBy(F.col(key).alias("of")).agg(F.slice(F.array_sort(F.collect_list(line)), 1, SHOWN).alias("first"))
    counts = rows.groupBy(key).agg(F.count(line).alias("count"))
    out = counts.join(first, F.col(key) == F.col("of"))
    return out.select(key, "count", F.concat(F.lit("lines "), F.array_join(F.transform("first", lambda x: x.cast("string")), ", "), F.when(F.col("count") > SHOWN, ", ...").otherwise("")).alias("summary"))
