"""Connected components by alternating large-star and small-star steps, DataFrames only but for a local first contraction.

A round deals all edges out several times, which costs as many tasks for few edges as for many. So what fits within `FEW_EDGES`, at
the start or after a round, is contracted by the tasks that read it and then by one; the bound holds whatever the size of the input, and
larger graphs go on in rounds.

A hub's edges meet a table of one row a node in each join. That table is stored first, so both sides of the join are plain
shuffles (or the small one is broadcast), and the adaptive skew join deals a hub's edges to many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import released, removed, stored

#: Edges that a task contracts at a time.
LOCAL_EDGES = 500_000

#: Edges that are left to one task: less work than the tasks of a round are to start. At most LOCAL_EDGES, so that it contracts them at a time.
FEW_EDGES = 1 << 17


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        top = x
        while (nxt := up.get(top, top)) != top:
            top = nxt
        while (nxt := up.get(x, x)) != top:
            up[x], x = top, nxt
        return top

    def link(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        return True

    def edges(self) -> tuple[list, list]:
        """Every member but the roots, and its root."""
        members = list(self.up)
        return members, [self.root(x) for x in members]


def contraction(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From batches of edges (a, b) to edges with the same components, at most one a node in each LOCAL_EDGES."""
    forest, kind = Forest(), None

    def out() -> pa.RecordBatch:
        members, roots = forest.edges()
        return pa.RecordBatch.from_arrays([pa.array(members, kind), pa.array(roots, kind)], names=["a", "b"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.link(a, b)
        if len(forest.up) >= LOCAL_EDGES:
            yield out()
            forest = Forest()
    if kind is not None and forest.up:
        yield out()
    released()


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components, at most one a node in each task's share."""
    node = dict(edges.dtypes)["a"]
    return edges.where("a <> b").select("a", "b").mapInArrow(contraction, f"a {node}, b {node}")


def components(edges: DataFrame, folder: str, most_rounds: int = 64, forests: bool = False, few: int = FEW_EDGES) -> DataFrame:
    """(a, b): every node of the edges (a, b) but the smallest of its component, and that smallest.

    forests: each task's edges are contracted already. few: so many edges are left to one task. The rounds needed grow with the logarithm of the longest path, so `most_rounds` is a guard against errors, no limit on data.
    """
    spark = edges.sparkSession
    now, before = stored(edges if forests else contracted(edges), f"{folder}/0"), None
    for k in range(1, most_rounds + 1):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        if state[0] <= min(few, LOCAL_EDGES):
            now = stored(contracted(contracted(now).repartition(1)), f"{folder}/{k}")
            removed(spark, f"{folder}/{k - 1}")
            break
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m")).select("of", F.least("of", "m").alias("m"))
        least = stored(least, f"{folder}/{k}-least")
        large = both.where("b > a").join(least, F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.distinct(), f"{folder}/{k}-large")
        small = stored(large.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m")), f"{folder}/{k}-small")
        moved = large.join(small, F.col("a") == F.col("of")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = stored(moved.unionByName(small.select(F.col("of").alias("a"), F.col("m").alias("b"))).distinct(), f"{folder}/{k}")
        removed(spark, f"{folder}/{k - 1}", *(f"{folder}/{k}-{x}" for x in ("least", "large", "small")))
        now = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now
