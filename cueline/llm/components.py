"""Connected components by alternating stars; every round is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueline.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the component's smallest node.

    Large star: a node hangs its larger neighbours on the smallest of its neighbourhood.  Small star: it
    hangs the smaller ones there.  Minima combine on the map side and a node with very many
    neighbours is split by the adaptive join, so no neighbourhood is gathered.  Stops when nothing changes.
    """
    current = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = None
    while True:
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).select("c", F.least("c", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct())
        lower = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        small = large.join(lower, F.col("u") == F.col("c"))
        hung = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select(F.col("c").alias("u"), F.col("m").alias("v")))
        current = stored(hung.where("u <> v").distinct())
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
