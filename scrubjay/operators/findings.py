"""Where and why each character of a text goes or stays.

A text is cut at the characters that a rule decides about, inside its row; only those become rows. Lines and columns are running
sums over them, so what is shuffled grows with the findings, not with the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chars
from ..functions.text import Options


def name_of(point: Column) -> Column:
    """The Unicode name of a code point that a rule knows; tags are named by number."""
    names = F.create_map(*(F.lit(x) for pair in sorted(chars.NAMES.items()) for x in pair))
    return F.coalesce(F.try_element_at(names, point), F.concat(F.lit("TAG U+"), F.upper(F.hex(point))))


def is_one_of(point: Column, points) -> Column:
    return point.isin([int(p) for p in points])


def joins(neighbour: Column) -> Column:
    """Whether a joiner beside this character has something to join."""
    return F.coalesce(neighbour.rlike(f"^[{chars.context_class()}]$"), F.lit(False))


def specials(text: Column, options: Options) -> Column:
    """Array of (gap before, special, character before, character after) of a text."""
    pattern = chars.special_pattern(options.ascii_punct)
    pieces = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def rows(p: Column) -> Column:
        def row(special: Column, i: Column) -> Column:
            before, after = F.concat(F.coalesce(F.get(p["found"], i - 1), F.lit("")), F.get(p["gaps"], i)), F.concat(F.get(p["gaps"], i + 1), F.coalesce(F.get(p["found"], i + 1), F.lit("")))
            return F.struct(F.get(p["gaps"], i).alias("gap"), special.alias("special"), F.right(before, F.lit(1)).alias("before"), F.left(after, F.lit(1)).alias("after"))

        return F.transform(p["found"], row)

    return F.when(text.rlike(pattern), F.get(F.transform(F.array(pieces), rows), F.lit(0)))


def findings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: Options = Options()) -> DataFrame:
    """id_col, pos, codepoint, name, line, column, action, reason of every decision. Repeated ids are texts of their own."""
    text = F.col("body")
    rows = df.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("body")).withColumn("place", F.monotonically_increasing_id())
    rows = rows.select("row_id", "place", F.posexplode(specials(text, options)).alias("pos", "at")).select("row_id", "place", "pos", "at.*")
    gap, point = F.col("gap"), F.col("codepoint")
    lines = F.char_length(gap) - F.char_length(F.replace(gap, F.lit("\n"), F.lit("")))
    stray = point.between(0xE0020, 0xE007F)
    sequence = F.char_length("special") > 1
    rows = rows.withColumns({"codepoint": F.ascii("special"), "lines": lines}).withColumns({"steps": F.char_length(gap) - F.col("lines"), "tail": F.char_length(F.substring_index(gap, "\n", -1)), "own": F.when(stray, 0).otherwise(F.char_length("special"))})
    upto = Window.partitionBy("place").orderBy("pos")
    rows = rows.withColumns({"walked": F.sum(F.col("steps") + F.col("own")).over(upto) - F.col("own"), "line": (F.sum("lines").over(upto) + 1).cast("int")})
    newest = F.last(F.when(F.col("lines") > 0, F.col("walked") - F.col("tail")), ignorenulls=True).over(upto)
    rows = rows.withColumn("column", (F.col("walked") - F.coalesce(newest, F.lit(0)) + 1).cast("int"))
    joiner, bom, bidi = is_one_of(point, chars.JOINER_NAMES), point == 0xFEFF, is_one_of(point, chars.BIDI_NAMES)
    kept_joiner = joins(F.col("before")) | joins(F.col("after"))
    at_start = (F.col("pos") == 0) & (F.col("gap") == "")
    kept, gone = F.lit("kept"), F.lit("removed")
    action = F.when(joiner, F.when(kept_joiner, kept).otherwise(gone)).when(bidi, kept if options.keep_bidi else gone).when(is_one_of(point, chars.TYPOGRAPHY), "replaced").otherwise(gone)
    to = F.create_map(*(F.lit(x) for cp, (t, _) in sorted(chars.TYPOGRAPHY.items()) for x in (cp, "-> " + repr(t))))
    reason = (
        F.when(stray, "outside an emoji tag sequence")
        .when(joiner, F.when(kept_joiner, "joins adjacent script or emoji").otherwise("isolated between non-joining characters"))
        .when(bom, F.when(at_start, "byte order mark").otherwise("mid-text"))
        .when(bidi, "bidi control")
        .otherwise(F.coalesce(F.try_element_at(to, point), F.lit("")))
    )
    silent = sequence if options.strip_bom else sequence | (bom & at_start)
    out = rows.where(~silent).select(F.col("row_id").alias(id_col), (F.row_number().over(upto) - 1).alias("pos"), "codepoint", name_of(point).alias("name"), "line", "column", action.alias("action"), reason.alias("reason"))
    return out


def rendered(codepoint: str = "codepoint", name: str = "name", line: str = "line", column: str = "column", action: str = "action", reason: str = "reason") -> Column:
    """U+XXXX NAME — line L, col C: action (reason)."""
    point = F.lpad(F.hex(codepoint), F.greatest(F.lit(4), F.length(F.hex(codepoint))), F.lit("0"))
    base = F.concat(F.lit("U+"), point, F.lit(" "), F.col(name), F.lit(" — line "), F.col(line).cast("string"), F.lit(", col "), F.col(column).cast("string"), F.lit(": "), F.col(action))
    return F.when(F.col(reason) == "", base).otherwise(F.concat(base, F.lit(" ("), F.col(reason), F.lit(")")))


def listing(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, changes, lines: the findings that are not mere keeps, as a report shows them."""
    gone = found.where("action <> 'kept'").withColumn("shown", rendered())
    ordered = F.array_sort(F.collect_list(F.struct("pos", "shown")))
    return gone.groupBy(id_col).agg(F.count(F.lit(1)).alias("changes"), F.transform(ordered, lambda x: x["shown"]).alias("lines"))
