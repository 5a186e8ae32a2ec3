"""Ordered running aggregates that do not put one group into one task.

A window partitioned by session alone sends the whole session through a single
task.  One recording can hold a large share of all rows, so every ordered
computation here is split by a *chunk*: a deterministic integer column that
never decreases along the order (a slice of the time axis, a block of row
numbers, a score band).

``scan`` works in two levels.  Each chunk is reduced to one summary row
(pre-aggregated before the shuffle), the summaries of a group are accumulated
in order, and the value carried into a chunk is joined back and combined with a
window inside the chunk.  Only the summaries of a group meet in one task.

Columns named in ``by`` must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.session import settle

#: Width of a time chunk in milliseconds.
CHUNK_MS = 600_000
#: Rows per chunk where the order key is a dense row number.
CHUNK_ROWS = 4096

_CHUNK = "__chunk"


@dataclass(frozen=True)
class Running:
    """One running aggregate: ``kind`` over the rows before (or after) a row."""

    kind: str
    value: Column
    inclusive: bool
    reverse: bool


def running_sum(value: Column, inclusive: bool = True, reverse: bool = False) -> Running:
    return Running("sum", value, inclusive, reverse)


def running_count(inclusive: bool = True, reverse: bool = False) -> Running:
    return Running("sum", F.lit(1).cast("bigint"), inclusive, reverse)


def running_max(value: Column, inclusive: bool = False, reverse: bool = False) -> Running:
    return Running("max", value, inclusive, reverse)


def running_min(value: Column, inclusive: bool = False, reverse: bool = False) -> Running:
    return Running("min", value, inclusive, reverse)


def nearest_value(value: Column, inclusive: bool = False, reverse: bool = False) -> Running:
    """Closest non-null value before the row (after it when ``reverse``)."""
    return Running("last", value, inclusive, reverse)


def time_chunk(column: str | Column, width: int = CHUNK_MS) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.floor(column / F.lit(width)).cast("bigint")


def row_chunk(column: str | Column, rows: int = CHUNK_ROWS) -> Column:
    return time_chunk(column, rows)


def as_list(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def _total(run: Running, order: Column) -> Column:
    if run.kind == "last":
        known = F.when(run.value.isNotNull(), order)
        return F.min_by(run.value, known) if run.reverse else F.max_by(run.value, known)
    return {"sum": F.sum, "max": F.max, "min": F.min}[run.kind](run.value)


def _over(kind: str, value: Column, window) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](value).over(window)


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "max":
        return F.greatest(carried, local)
    if kind == "min":
        return F.least(carried, local)
    return F.coalesce(local, carried)


def scan(
    df: DataFrame,
    by: str | Sequence[str],
    order: Sequence[str],
    chunk: Column,
    **runs: Running,
) -> DataFrame:
    """Add one column per running aggregate in ``runs``.

    ``order`` names columns that give a total order, ascending; ``chunk`` must
    not decrease along it.
    """
    by = as_list(by)
    keys = [*by, _CHUNK]
    rows = settle(df).withColumn(_CHUNK, chunk)
    # a single column goes without its struct, so that the totals of numbers are kept in a hash table
    order_key = F.col(order[0]) if len(order) == 1 else F.struct(*order)

    totals = rows.groupBy(*keys).agg(
        *[_total(run, order_key).alias(f"__total_{name}") for name, run in runs.items()]
    )
    before = Window.partitionBy(*by).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    after = (
        Window.partitionBy(*by).orderBy(F.desc(_CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = totals.select(
        *keys,
        *[
            _over(run.kind, F.col(f"__total_{name}"), after if run.reverse else before).alias(
                f"__carry_{name}"
            )
            for name, run in runs.items()
        ],
    )

    def local(run: Running) -> Column:
        ordering = [F.desc(c) for c in order] if run.reverse else [F.asc(c) for c in order]
        window = (
            Window.partitionBy(*keys)
            .orderBy(*ordering)
            .rowsBetween(Window.unboundedPreceding, 0 if run.inclusive else -1)
        )
        return _over(run.kind, run.value, window)

    # the windows come first: their rows lie in the order that the join by chunk needs, so nothing is sorted for it
    placed = rows.select("*", *[local(run).alias(f"__local_{name}") for name, run in runs.items()])
    return placed.join(carried, keys, "left").select(
        *[F.col(c) for c in df.columns if c not in runs],
        *[
            _combine(run.kind, F.col(f"__carry_{name}"), F.col(f"__local_{name}")).alias(name)
            for name, run in runs.items()
        ],
    )


def with_neighbours(
    df: DataFrame,
    by: str | Sequence[str],
    order: Sequence[str],
    chunk: Column,
    previous: dict[str, str] | None = None,
    following: dict[str, str] | None = None,
) -> DataFrame:
    """``lag`` / ``lead`` by one row: output name -> input column."""
    runs = {}
    if previous:
        packed = F.struct(*[F.col(c).alias(n) for n, c in previous.items()])
        runs["__packed_prev"] = nearest_value(packed)
    if following:
        packed = F.struct(*[F.col(c).alias(n) for n, c in following.items()])
        runs["__packed_next"] = nearest_value(packed, reverse=True)
    out = scan(df, by, order, chunk, **runs)
    for name in previous or {}:
        out = out.withColumn(name, F.col(f"__packed_prev.{name}"))
    for name in following or {}:
        out = out.withColumn(name, F.col(f"__packed_next.{name}"))
    return out.drop("__packed_prev", "__packed_next")


def with_position(
    df: DataFrame,
    by: str | Sequence[str],
    order: Sequence[str],
    chunk: Column,
    name: str = "pos",
    start: int = 1,
) -> DataFrame:
    """Row number inside the group, counted from ``start``."""
    out = scan(df, by, order, chunk, **{name: running_count()})
    return out.withColumn(name, F.col(name) + F.lit(start - 1)) if start != 1 else out


def values_at_ranks(
    df: DataFrame,
    by: str | Sequence[str],
    value: str,
    ranks: dict[str, Column],
    band: Column,
) -> DataFrame:
    """Exact order statistics per group: the values at 0-based ``ranks``.

    A rank is an expression over ``n`` (rows in the group), which is returned
    too.  Equal values are counted before the shuffle; ``band`` is a
    non-decreasing integer function of the value and plays the part of the chunk.
    """
    by = as_list(by)
    keys = [*by, _CHUNK]
    counts = settle(
        df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n")).withColumn(_CHUNK, band), 1
    )
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    group = Window.partitionBy(*by).orderBy(_CHUNK)
    below = F.coalesce(F.sum("__total").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    size = F.sum("__total").over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    bands = totals.select(*keys, "__total", below.alias("__below"), size.alias("n"))
    # only the bands that hold a rank are put in order; the first one keeps a group whose ranks lie outside of it
    held = F.col("__below") == 0
    for rank in ranks.values():
        held |= (rank >= F.col("__below")) & (rank < F.col("__below") + F.col("__total"))
    rows = counts.join(bands.filter(held).drop("__total"), keys)
    inside = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("__upto", F.col("__below") + F.sum("__n").over(inside))
    first = F.col("__upto") - F.col("__n")
    return placed.groupBy(*by, "n").agg(
        *[
            F.max(F.when((rank < F.col("__upto")) & (rank >= first), F.col(value))).alias(name)
            for name, rank in ranks.items()
        ]
    )


def exact_percentile(
    df: DataFrame, by: str | Sequence[str], value: str, p: float, band: Column, name: str
) -> DataFrame:
    """Linearly interpolated percentile (0-100) per group, exact at any size."""
    by = as_list(by)
    place = F.lit(p / 100.0) * (F.col("n") - 1)
    ends = values_at_ranks(
        df, by, value, {"__low": F.floor(place), "__high": F.ceil(place)}, band
    )
    part = place - F.floor(place)
    return ends.select(
        *by, (F.col("__low") + (F.col("__high") - F.col("__low")) * part).alias(name), "n"
    )
