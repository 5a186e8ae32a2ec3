"""Greedy segments with a cap, computed without a task per session.

Joining rows until a length or duration is used up depends on where the open
segment began, which no window can express.  Here the ordered rows are cut into
blocks of bounded size and three passes are made:

1. each block is reduced to a small transfer table: for every way an open
   segment can come in, which segment is open at the end;
2. the tables of one session are chained in order (a few numbers per block);
3. each block is replayed with the segment that really comes in.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueline.operators.scan import CHUNK_ROWS, as_list, running_count, scan
from cueline.session import settle


def _over(high, low, cap: float, inclusive: bool):
    used = high - low
    return used >= cap if inclusive else used > cap


def _next_open(at: int, low: float, rows: dict, cap: float, inclusive: bool) -> int:
    """First row from ``at`` on that opens a segment when one with ``low`` is open."""
    hard, soft, high = rows["hard"], rows["soft"], rows["high"]
    step = 64
    while at < len(hard):
        stop = min(at + step, len(hard))
        opens = hard[at:stop] | (soft[at:stop] & _over(high[at:stop], low, cap, inclusive))
        if opens.any():
            return at + int(opens.argmax())
        at, step = stop, step * 4
    return len(hard)


def _arrays(pdf: pd.DataFrame) -> dict:
    return {
        "hard": pdf["__hard"].to_numpy(dtype=bool),
        "soft": pdf["__soft"].to_numpy(dtype=bool),
        "high": pdf["__high"].to_numpy(dtype=float),
        "low": pdf["__low"].to_numpy(dtype=float),
        "pos": pdf["__pos"].to_numpy(dtype=np.int64),
    }


def _starts(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where a new group begins in rows sorted by ``keys``."""
    changed = np.zeros(len(pdf), dtype=bool)
    changed[:1] = True
    for c in keys:
        values = pdf[c].to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(changed)


def _whole_groups(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of sorted rows, cut so that no group is split between two of them."""
    rest = None
    for pdf in batches:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        if pdf.empty:
            continue
        last = int(_starts(pdf, keys)[-1])
        rest = pdf.iloc[last:]
        if last:
            yield pdf.iloc[:last]
    if rest is not None:
        yield rest


def dealt(df: DataFrame, group: Sequence[str], *more: str) -> DataFrame:
    """The rows with all of a group in one partition, sorted by the group and ``more``.

    By a hash of the group, not by its columns: behind a join on the same columns Spark drops the exchange, and when
    that join turns out small enough to broadcast, its rows are read where they lie and the groups are torn.
    """
    return df.repartition(F.xxhash64(*group)).sortWithinPartitions(*group, *more)


def _transfer(rows: dict, cap: float, inclusive: bool):
    """Thresholds and the segment open at the end, for each way to come in."""
    size = len(rows["pos"])
    ends: dict[int, int] = {}

    def final(row: int) -> int:
        path = []
        while row not in ends:
            path.append(row)
            following = _next_open(row + 1, rows["low"][row], rows, cap, inclusive)
            if following >= size:
                ends[row] = row
                break
            row = following
        for seen in path:
            ends[seen] = ends[row]
        return ends[row]

    firm = int(rows["hard"].argmax()) if rows["hard"].any() else size
    reach = -np.inf
    table: list[tuple[float, int]] = []
    for row in np.flatnonzero(rows["soft"][:firm]):
        if rows["high"][row] > reach:
            reach = rows["high"][row]
            stop = final(int(row))
            if table and table[-1][1] == stop:
                table[-1] = (reach, stop)
            else:
                table.append((reach, stop))
    if firm < size:
        table.append((np.inf, final(firm)))
    picked = [stop for _, stop in table]
    return (
        [float(t) for t, _ in table],
        [float(rows["low"][p]) for p in picked],
        [int(rows["pos"][p]) for p in picked],
    )


def capped_segments(
    df: DataFrame,
    by: str | Sequence[str],
    order: Sequence[str],
    chunk: Column,
    hard: Column,
    high: Column,
    low: Column,
    cap: float,
    soft: Column | None = None,
    inclusive: bool = False,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Adds ``segment``, the position of the row that opened the row's segment.

    A row opens a segment when ``hard`` holds, or when ``soft`` holds and
    ``high`` exceeds the ``low`` of the open segment's first row by more than
    ``cap`` (by at least ``cap`` with ``inclusive``).  ``pos`` counts the rows.
    """
    by = as_list(by)
    placed = scan(df, by, order, chunk, pos=running_count())
    ready = settle(
        placed.select(
            *placed.columns,
            (F.coalesce(hard, F.lit(True)) | (F.col("pos") == 1)).alias("__hard"),
            F.coalesce(soft if soft is not None else F.lit(True), F.lit(False)).alias("__soft"),
            high.cast("double").alias("__high"),
            low.cast("double").alias("__low"),
            F.col("pos").alias("__pos"),
            F.floor(F.col("pos") / rows).cast("bigint").alias("__block"),
        ),
        1,
    )
    keys = [ready.schema[c] for c in by]
    block = [*by, "__block"]

    def summarize(batches):
        for pdf in _whole_groups(batches, block):
            data = _arrays(pdf)
            begins = _starts(pdf, block)
            tables = [
                _transfer({c: v[lo:hi] for c, v in data.items()}, cap, inclusive)
                for lo, hi in zip(begins, [*begins[1:], len(pdf)])
            ]
            heads = pdf.iloc[begins][block].reset_index(drop=True)
            yield heads.assign(
                steps=[s for s, _, _ in tables], lows=[v for _, v, _ in tables], stops=[x for *_, x in tables]
            )

    summary_type = T.StructType(
        [
            *keys,
            T.StructField("__block", T.LongType()),
            T.StructField("steps", T.ArrayType(T.DoubleType())),
            T.StructField("lows", T.ArrayType(T.DoubleType())),
            T.StructField("stops", T.ArrayType(T.LongType())),
        ]
    )
    narrow = ready.select(*block, "__pos", "__hard", "__soft", "__high", "__low")
    summary = dealt(narrow, block, "__pos").mapInPandas(summarize, summary_type)

    def chain(batches):
        low, segment, before = 0.0, 0, None
        for pdf in batches:
            low_in, seg_in = [], []
            groups = zip(*[pdf[c] for c in by])
            for group, steps, lows, stops in zip(groups, pdf["steps"], pdf["lows"], pdf["stops"]):
                if group != before:
                    low, segment, before = 0.0, 0, group
                low_in.append(low)
                seg_in.append(segment)
                hit = np.flatnonzero(_over(np.asarray(steps, dtype=float), low, cap, inclusive))
                if len(hit):
                    low, segment = float(lows[hit[0]]), int(stops[hit[0]])
            yield pdf[block].assign(__low_in=low_in, __seg_in=seg_in)

    carry_type = T.StructType(
        [
            *keys,
            T.StructField("__block", T.LongType()),
            T.StructField("__low_in", T.DoubleType()),
            T.StructField("__seg_in", T.LongType()),
        ]
    )
    carried = dealt(summary, by, "__block").mapInPandas(chain, carry_type)

    def replay(batches):
        low, segment, before = 0.0, 0, None
        for pdf in batches:
            data = _arrays(pdf)
            begins = _starts(pdf, block) if len(pdf) else []
            out = np.empty(len(pdf), dtype=np.int64)
            for lo, hi in zip(begins, [*begins[1:], len(pdf)]):
                head = pdf.iloc[lo]
                group = tuple(head[c] for c in block)
                if group != before:
                    low, segment, before = float(head["__low_in"]), int(head["__seg_in"]), group
                part = {c: v[lo:hi] for c, v in data.items()}
                at = 0
                while at < hi - lo:
                    opening = _next_open(at, low, part, cap, inclusive)
                    out[lo + at : lo + opening] = segment
                    if opening < hi - lo:
                        low, segment = part["low"][opening], part["pos"][opening]
                        out[lo + opening] = segment
                    at = opening + 1
            yield pdf[[*by, "__pos"]].assign(segment=out)

    segment_type = T.StructType(
        [*keys, T.StructField("__pos", T.LongType()), T.StructField("segment", T.LongType())]
    )
    segments = dealt(narrow.join(carried, block), block, "__pos").mapInPandas(replay, segment_type)
    return ready.join(segments, [*by, "__pos"]).select(*placed.columns, "segment")
