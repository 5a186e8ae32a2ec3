"""Keyed state on streams: cues that become blocks, and tickets that a later run closes.

Rows of a key are held until the watermark has passed them and are then taken in the order of event time, so the result
doesn't depend on how the stream was cut into batches.  Rows behind the watermark are dropped by Spark.  A timer per key
fires for the next row to take or the next state to give out; a key with neither holds nothing.

Streams with such state need the RocksDB state store; ``keyed_state`` sets it where the session has another.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# the process that opens the state may not see this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a key that are held as one value: a call to the state costs more than the few rows most keys have.
CHUNK_ROWS = 1024
_CHUNK = T.StructType([T.StructField("chunk", T.LongType())])


def keyed_state(spark: SparkSession) -> None:
    """Make streams that start from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _plain(value):
    """Rows, also those inside, as tuples: the state takes no rows inside of others."""
    if isinstance(value, tuple):
        return tuple(map(_plain, value))
    return [_plain(v) for v in value] if isinstance(value, list) else value


class InOrder(StatefulProcessor):
    """Takes the rows of a key in the order of (at_ms, place), each when the watermark has passed it.

    ``row`` is the type of what is held of a row, its first two columns ``at_ms`` and ``place``; ``kept`` that of the state
    between rows.  Subclasses say what one row makes of the state, and when a state is due without a further row.
    """

    row: T.StructType
    kept: T.StructType
    names: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.given = handle, Row(*self.names)
        self.waiting = handle.getMapState("waiting", _CHUNK, T.StructType([T.StructField("rows", T.ArrayType(self.row))]))
        self.state = handle.getValueState("kept", self.kept)

    def take(self, key: tuple, state: tuple | None, row: tuple) -> tuple[list[tuple], tuple | None]:
        """Rows to give out, and the new state."""
        raise NotImplementedError

    def due(self, state: tuple) -> int:
        """The watermark (ms) at which the state gives something out by itself."""
        raise NotImplementedError

    def expire(self, key: tuple, state: tuple, watermark: int) -> tuple[list[tuple], tuple | None]:
        """Rows to give out at ``watermark``, and what is left of the state."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield from self._advance(key, [tuple(row[c] for c in self.row.names) for row in rows], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key, [], timerValues)

    def _advance(self, key, fresh, timers) -> Iterator[Row]:
        watermark = timers.getCurrentWatermarkInMs()
        chunks = {number: _plain(rows) for (number,), (rows,) in self.waiting.iterator()}
        # in the order of coming, which the sort keeps for rows of one place
        held = [row for number in sorted(chunks) for row in chunks[number]]
        found = _plain(self.state.get())
        timer, state = self._next(held, found), found
        rows = sorted(held + fresh, key=lambda row: row[:2])
        passed = 0
        for row in rows:
            if row[0] > watermark:
                break
            given, state = self.take(key, state, row)
            passed += 1
            yield from (self.given(*key, *g) for g in given)
        if state is not None and self.due(state) <= watermark:
            given, state = self.expire(key, state, watermark)
            yield from (self.given(*key, *g) for g in given)
        if passed and chunks:
            self.waiting.clear()
            chunks = {}
        rest = rows[passed:]
        self._hold(rest if passed else fresh, max(chunks, default=-1) + 1)
        if state is not None:
            self.state.update(state)
        elif found is not None:
            self.state.clear()
        due = self._next(rest, state)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)

    def _hold(self, rows: list[tuple], number: int) -> None:
        for at in range(0, len(rows), CHUNK_ROWS):
            self.waiting.updateValue((number,), (rows[at : at + CHUNK_ROWS],))
            number += 1

    def _next(self, rows: list[tuple], state: tuple | None) -> int | None:
        """The moment of the key's one timer, by what is held."""
        return min([row[0] for row in rows] + ([] if state is None else [self.due(state)]), default=None)

    def close(self) -> None:
        pass


def _held(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def _applied(stream: DataFrame, by: list[str], processor: InOrder, given: str) -> DataFrame:
    keyed_state(stream.sparkSession)
    keys = [stream.schema[c] for c in by]
    out = T.StructType([*keys, *_held(given).fields])
    processor.names = out.names
    return stream.groupBy(*by).transformWithState(processor, out, "Append", "EventTime")


# --- blocks -------------------------------------------------------------------------


class _Blocks(InOrder):
    def __init__(self, merge_gap_ms: int, max_block_ms: int):
        self.gap, self.cap = merge_gap_ms, max_block_ms
        self.row = _held("at_ms bigint, place bigint, start_ms bigint, end_ms bigint, speaker string, text string")
        self.kept = _held("at_ms bigint, start_ms bigint, end_ms bigint, speaker string, text string, cue_idx array<bigint>")

    def take(self, key, state, row):
        at, idx, start, end, speaker, text = row
        text = text or ""
        if state is not None:
            opened_at, first, last, owner, joined, cues = state
            if self.gap > 0 and owner == speaker and start - last < self.gap and end - first <= self.cap:
                return [], (opened_at - last + end, first, end, owner, joined + text, [*cues, idx])
        fresh = (at - start + end, start, end, speaker, text, [idx])
        return ([] if state is None else [tuple(state[1:])]), fresh

    def due(self, state):
        # a later cue starts behind the watermark, so too late to be joined
        return state[0] + self.gap

    def expire(self, key, state, watermark):
        return [tuple(state[1:])], None


def stream_blocks(cues: DataFrame, merge_gap_ms: int = 0, max_block_ms: int = 45_000, by: str = "session_id") -> DataFrame:
    """Blocks of a stream of cues as soon as nothing can join them, with the rows of ``build_blocks`` but for the number.

    ``cues`` has a watermark on ``at``, the moment a cue starts; ``start_ms`` counts from any origin of the session.
    Cues of one moment are taken in the order of ``idx``.  ``number_blocks`` numbers blocks that have been written.
    """
    rows = cues.withColumn("at_ms", F.unix_millis("at")).withColumn("place", F.col("idx"))
    given = "start_ms bigint, end_ms bigint, speaker string, text string, cue_idx array<bigint>"
    return _applied(rows, [by], _Blocks(merge_gap_ms, max_block_ms), given)


# --- tickets ------------------------------------------------------------------------


class _Tickets(InOrder):
    def __init__(self, keep_ms: int):
        self.keep = keep_ms
        self.row = _held("at_ms bigint, place bigint, closes boolean, issue string")
        self.kept = _held("tickets array<struct<at_ms: bigint, issue: string>>")

    def take(self, key, state, row):
        at, _, closes, issue = row
        tickets = list(state[0]) if state else []
        given, tickets = self._lapsed(tickets, at - 1)
        if closes:
            given += [(opened, what, "closed", at) for opened, what in tickets]
            tickets = []
        else:
            tickets.append((at, issue))
        return given, ((tickets,) if tickets else None)

    def _lapsed(self, tickets, until):
        """Tickets whose time ended by ``until``, given out open, and the others."""
        return [(a, w, "open", None) for a, w in tickets if a + self.keep <= until], [t for t in tickets if t[0] + self.keep > until]

    def due(self, state):
        return state[0][0][0] + self.keep

    def expire(self, key, state, watermark):
        given, tickets = self._lapsed(state[0], watermark)
        return given, ((tickets,) if tickets else None)


def stream_tickets(runs: DataFrame, keep: str = "7 days") -> DataFrame:
    """Every failed run of a stream once, as a ticket that the next passed run of its stage and session has closed, or open.

    ``runs`` has a watermark on ``ts``.  A ticket is given out when it is closed, or open when ``keep`` has gone by without
    that.  Of runs of one moment failures come first.
    """
    keep_ms = int(runs.sparkSession.sql(f"SELECT unix_millis(timestamp '1970-01-01 00:00:00Z' + interval {keep})").first()[0])
    told = runs.where(F.col("status").isin("fail", "pass"))
    closes = F.col("status") == "pass"
    rows = told.select(
        F.col("stage").alias("source"),
        "session",
        "ts",
        F.unix_millis("ts").alias("at_ms"),
        closes.cast("bigint").alias("place"),
        closes.alias("closes"),
        F.coalesce("detail", F.lit("")).alias("issue"),
    )
    found = _applied(rows, ["source", "session"], _Tickets(keep_ms), "at_ms bigint, issue string, status string, closed_ms bigint")
    return found.select(
        F.timestamp_millis("at_ms").alias("ts"), "source", "session", "issue", F.lit("").alias("suggestion"), "status", F.timestamp_millis("closed_ms").alias("closed_ts")
    )
