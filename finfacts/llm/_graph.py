"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch


def _union(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components by union-find, of a partition that holds all edges."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    yield pd.DataFrame([(x, find(x)) for x in root], columns=["id", "component"], dtype="int64")


def components(edges: DataFrame, scratch: Scratch, one_task: int = 20_000) -> DataFrame:
    """(id, component) of every end of edges (a, b); component: the smallest id reachable.

    Rounds go on until the edges stay as they are. No node's edges meet in one task: minima are taken map-side, and a hub's edges meet
    its minimum in a join of two tables, which Spark splits. A list of at most one_task edges, which are counted, is cheaper in
    one task than in rounds of joins; the result is the same.
    """
    now = scratch.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    if now.count() <= one_task:
        return scratch.table(now.coalesce(1).mapInPandas(_union, "id long, component long"), "components")
    state = before = None
    while state is None or state != before:
        both = now.union(now.select("b", "a").toDF("a", "b"))
        low = scratch.table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = scratch.table(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct(), "large")
        low = scratch.table(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a != b").distinct()
        now = scratch.table(small, "small")
        before, state = state, tuple(now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")), F.lit(0))).first())
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
