"""Ranges of code points as tables: merging them, and looking points up in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chars


def context_table(spark: SparkSession) -> DataFrame:
    """(lo, hi) of the code points beside which a joiner stays: some hundreds of rows, whatever the input."""
    return spark.createDataFrame([(a, b) for a, b in chars.context_ranges()], "lo int, hi int")


def merged(ranges: DataFrame, key: str = "key") -> DataFrame:
    """(key, lo, hi): ranges of a key that overlap or touch, as one. Islands begin where no earlier range reaches."""
    earlier = Window.partitionBy(key).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key).orderBy("lo", "hi")
    begins = F.coalesce(F.col("lo") > F.max("hi").over(earlier) + 1, F.lit(True))
    islands = ranges.withColumn("begins", begins.cast("int")).withColumn("island", F.sum("begins").over(upto))
    return islands.groupBy(key, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def members(points: DataFrame, ranges: DataFrame, point: str = "codepoint") -> DataFrame:
    """Rows whose point lies in a range. Few distinct points are looked up, whatever the number of rows, and joined by value."""
    distinct = points.select(F.col(point).alias("p")).distinct()
    inside = distinct.join(F.broadcast(ranges), (F.col("p") >= F.col("lo")) & (F.col("p") <= F.col("hi")), "left_semi")
    return points.join(inside, F.col(point) == F.col("p"), "left_semi")
