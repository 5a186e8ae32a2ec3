"""Placing rows of different kinds on one timeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueline.operators.scan import (
    CHUNK_MS,
    as_list,
    nearest_value,
    running_count,
    running_max,
    scan,
    time_chunk,
)


def timeline_merge(
    parts: dict[str, DataFrame],
    by: str | Sequence[str] = "session_id",
    tie: str = "ref",
    chunk_ms: int = CHUNK_MS,
) -> DataFrame:
    """Union in time order; at one time the kinds follow the order given.

    Each part has ``t_ms`` and the ``tie`` column; ``seq`` numbers the result.
    """
    by = as_list(by)
    labelled = [
        df.withColumn("kind", F.lit(kind)).withColumn("__place", F.lit(i))
        for i, (kind, df) in enumerate(parts.items())
    ]
    merged = labelled[0]
    for part in labelled[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    ordered = scan(
        merged, by, ["t_ms", "__place", tie], time_chunk("t_ms", chunk_ms), seq=running_count()
    )
    return ordered.drop("__place")


def insert_rows_before(
    rows: DataFrame,
    pauses: DataFrame,
    marks: DataFrame,
    by: str | Sequence[str] = "session_id",
    order: str = "idx",
    chunk_ms: int = CHUNK_MS,
) -> DataFrame:
    """Pause rows with the plan row each is to stand before.

    That is the first row in document order starting at or after the pause (to
    the second, as plans print times).  A tick given earlier to the pause
    starting in the same second is kept from ``marks(second, keep)``.
    """
    by = as_list(by)
    numbered = scan(
        pauses, by, ["start_ms"], time_chunk("start_ms", chunk_ms), __no=running_count()
    )
    # a row can be the first at or after some time only if it starts later than
    # every row before it in the document
    starts = rows.select(
        *by, F.col(order).alias("before"), (F.floor(F.col("start_ms") / 1000) * 1000).alias("t")
    )
    leaders = scan(
        starts, by, ["before"], time_chunk("before", 512), reach=running_max(F.col("t"))
    ).filter("reach IS NULL OR t > reach")
    events = leaders.select(
        *by, "t", F.lit(1).alias("k"), F.col("before").alias("no"), F.col("before")
    ).unionByName(
        numbered.select(
            *by,
            F.col("start_ms").alias("t"),
            F.lit(0).alias("k"),
            F.col("__no").alias("no"),
            F.lit(None).cast("bigint").alias("before"),
        )
    )
    found = scan(
        events,
        by,
        ["t", "k", "no"],
        time_chunk("t", chunk_ms),
        before_idx=nearest_value(F.col("before"), reverse=True),
    ).filter("k = 0")
    ticks = marks.groupBy(*by, "second").agg(F.max("keep").alias("keep"))
    return (
        found.withColumn("second", F.floor(F.col("t") / 1000))
        .join(ticks, [*by, "second"], "left")
        .select(
            *by,
            F.format_string("P%04d", "no").alias("row_id"),
            F.col("t").alias("start_ms"),
            "before_idx",
            F.coalesce("keep", F.lit(False)).alias("keep"),
        )
    )
