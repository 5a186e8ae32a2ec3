"""Playing order without replays, computed without a task per session.

Whether a segment is moved or goes depends on the last one kept, so on all before it.  What comes into a block
of rows is two numbers: start and end of the last segment kept.  As a function of these a block takes few
forms, so every block is reduced to a list of rules, the rules of a session are applied in order, and each block
is replayed with what really comes in.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueline.operators.scan import CHUNK_ROWS, as_list, running_count, running_max, scan, time_chunk
from cueline.operators.segments import _starts, _whole_groups, dealt
from cueline.session import settle

#: Times before and after all others; in a rule's result, the end that came in.
NEVER, ALWAYS, CAME_IN = -(1 << 62), 1 << 62, (1 << 62) + 1


class Block:
    """Segments of one block in playing order, none shorter than ``least``.

    The state is (start, end) of the last segment kept.  A segment goes if it starts after that start and ends less
    than ``least`` after that end; of those that stay, one that starts between the two is moved to the end.
    """

    def __init__(self, start: np.ndarray, end: np.ndarray, least: int):
        self.start, self.end, self.least = start, end, least
        self.known: dict[tuple[int, int], tuple[int, int]] = {}

    def next_kept(self, at: int, start: int, end: int) -> int:
        """The first segment from ``at`` on that stays; the number of segments if none does."""
        step = 32
        while at < len(self.start):
            stays = (self.start[at : at + step] <= start) | (self.end[at : at + step] >= end + self.least)
            if stays.any():
                return at + int(stays.argmax())
            at, step = at + step, step * 4
        return len(self.start)

    def kept_start(self, row: int, start: int, end: int) -> int:
        own = int(self.start[row])
        return end if start < own < end else own

    def final(self, row: int, start: int) -> tuple[int, int]:
        """The state at the end of the block once ``row`` was kept with this start."""
        way = []
        while (state := self.known.get((row, start))) is None:
            way.append((row, start))
            end = int(self.end[row])
            following = self.next_kept(row + 1, start, end)
            if following == len(self.start):
                state = start, end
                break
            row, start = following, self.kept_start(following, start, end)
        self.known |= dict.fromkeys(way, state)
        return state

    def rules(self, reach: int) -> list[list[int]]:
        """(least start, least end, greatest end, start after, end after), of which the first that fits the state holds.

        ``reach`` is the greatest end before the block: states beyond it can't come in, so there are about as many rules as
        segments that overlap what lies before the block.
        """
        found = []
        lowest, highest = ALWAYS, NEVER
        for row, (start, end) in enumerate(zip(self.start.tolist(), self.end.tolist(), strict=True)):
            if start < lowest:
                lowest = start
                if start <= reach:
                    found.append([start, NEVER, ALWAYS, *self.final(row, start)])
            if end > highest:
                if start > highest - self.least:
                    found.append([NEVER, NEVER, start, *self.final(row, start)])
                found += self.moved(row, max(highest - self.least, start))
                highest = end
                if end - self.least >= reach:
                    break
        return found

    def moved(self, row: int, above: int) -> Iterator[list[int]]:
        """Rules for ``row`` kept and moved, by the end over ``above`` that came in and is its start now."""
        end = int(self.end[row])
        top = end - self.least
        at = row + 1
        while top > above:
            at = self.next_kept(at, top, end)
            if at == len(self.start):
                yield [NEVER, above + 1, top, CAME_IN, end]
                return
            start = int(self.start[at])
            if start <= top:
                yield [NEVER, max(start, above + 1), top, *self.final(at, start)]
                top = start - 1
            if self.end[at] >= end + self.least:
                if top > above:
                    yield [NEVER, above + 1, top, *self.final(at, end if start < end else start)]
                return
            at += 1

    def replay(self, start: int, end: int) -> tuple[list[int], list[int]]:
        """The segments kept, and their starts."""
        rows, starts, at = [], [], 0
        while (at := self.next_kept(at, start, end)) < len(self.start):
            start, end = self.kept_start(at, start, end), int(self.end[at])
            rows.append(at)
            starts.append(start)
            at += 1
        return rows, starts


def after(rules: Sequence[Sequence[int]], start: int, end: int) -> tuple[int, int]:
    """The state behind a block with these rules."""
    for least, low, high, new_start, new_end in rules:
        if start >= least and low <= end <= high:
            return (end if new_start == CAME_IN else int(new_start)), int(new_end)
    return start, end


def enforce_monotonic(
    segments: DataFrame,
    by: str | Sequence[str] = "session_id",
    min_frag_ms: int = 120,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """No stretch of the source plays twice: starts are moved to the previous end.

    ``segments(seq, kind, clip, start_ms, end_ms)`` in playing order; only speech that is no clip is touched, and pieces
    under ``min_frag_ms`` or without both times go.  Chains of overlaps may be of any length: a task holds a block
    of ``rows`` segments, and only the blocks' rules meet by session.
    """
    by = as_list(by)
    touched = F.coalesce((F.col("kind") == "speech") & ~F.col("clip"), F.lit(False))
    # a short segment is never kept, moved or not, so it bears on no other
    speech = segments.filter(touched & (F.col("end_ms") - F.col("start_ms") >= min_frag_ms))
    order = ["seq", "start_ms", "end_ms"]
    placed = scan(speech, by, order, time_chunk("seq", rows), __pos=running_count(), __reach=running_max(F.col("end_ms").cast("bigint")))
    ready = settle(placed.withColumn("__block", F.floor(F.col("__pos") / rows).cast("bigint")), 1)
    block = [*by, "__block"]
    keys = [ready.schema[c] for c in by]
    long = T.LongType()
    narrow = ready.select(
        *block,
        "__pos",
        F.col("start_ms").cast("bigint").alias("__start"),
        F.col("end_ms").cast("bigint").alias("__end"),
        F.coalesce("__reach", F.lit(NEVER)).alias("__reach"),
    )

    def blocks(pdf: pd.DataFrame) -> Iterator[tuple[int, int, Block]]:
        begins = _starts(pdf, block)
        start, end = pdf["__start"].to_numpy(np.int64), pdf["__end"].to_numpy(np.int64)
        for lo, hi in zip(begins, [*begins[1:], len(pdf)], strict=True):
            yield int(lo), int(hi), Block(start[lo:hi], end[lo:hi], min_frag_ms)

    def summarize(batches):
        for pdf in _whole_groups(batches, block):
            found = [(lo, part.rules(int(pdf["__reach"].iloc[lo]))) for lo, _, part in blocks(pdf)]
            yield pdf.iloc[[lo for lo, _ in found]][block].assign(rules=[r for _, r in found])

    def chain(batches):
        before, state = None, (NEVER, NEVER)
        for pdf in batches:
            came = []
            for group, rules in zip(zip(*[pdf[c] for c in by], strict=True), pdf["rules"], strict=True):
                if group != before:
                    before, state = group, (NEVER, NEVER)
                came.append(state)
                state = after(rules, *state)
            yield pdf[block].assign(__from=[s for s, _ in came], __until=[e for _, e in came])

    def replay(batches):
        for pdf in _whole_groups(batches, block):
            at, starts = [], []
            for lo, _, part in blocks(pdf):
                kept, moved = part.replay(int(pdf["__from"].iloc[lo]), int(pdf["__until"].iloc[lo]))
                at += [lo + r for r in kept]
                starts += moved
            yield pdf.iloc[at][[*by, "__pos"]].assign(__start=starts)

    head = [*keys, T.StructField("__block", long)]
    summary = dealt(narrow, block, "__pos").mapInPandas(
        summarize, T.StructType([*head, T.StructField("rules", T.ArrayType(T.ArrayType(long)))])
    )
    states = dealt(summary, by, "__block").mapInPandas(
        chain, T.StructType([*head, T.StructField("__from", long), T.StructField("__until", long)])
    )
    starts = dealt(narrow.join(states, block), block, "__pos").mapInPandas(
        replay, T.StructType([*keys, T.StructField("__pos", long), T.StructField("__start", long)])
    )
    kept = ready.join(starts, [*by, "__pos"]).withColumn("start_ms", F.col("__start").cast(segments.schema["start_ms"].dataType))
    return kept.select(*segments.columns).unionByName(segments.filter(~touched))
