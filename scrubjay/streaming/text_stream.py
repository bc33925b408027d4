"""Text hygiene on streams. Cleaning is stateless, so it runs on a stream as on a table; the provenance gate is not offered
here, for a sidecar may arrive after its asset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import Options, changed, clean


def cleaned(stream: DataFrame, text_col: str = "text", options: Options = Options()) -> DataFrame:
    """The stream with `clean` and `changed` columns."""
    out = stream.withColumn("clean", clean(text_col, options))
    return out.withColumn("changed", changed(F.col(text_col), F.col("clean")))


def counts(stream: DataFrame, time_col: str, text_col: str = "text", window: str = "5 minutes", late: str = "10 minutes", options: Options = Options()) -> DataFrame:
    """Texts, changed texts and removed characters by window of event time; later rows than `late` are left out."""
    rows = cleaned(stream.withWatermark(time_col, late), text_col, options)
    gone = F.char_length(text_col) - F.char_length("clean")
    return rows.groupBy(F.window(time_col, window).alias("window")).agg(F.count(F.lit(1)).alias("texts"), F.count_if("changed").alias("changed"), F.sum(gone).alias("removed"))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, into Parquet, and stop."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
