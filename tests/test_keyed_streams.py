"""Blocks and tickets of streams, in several cuts into batches and over restarts, against their batch forms."""

from __future__ import annotations

import os
import random
import uuid

from pyspark.sql import Row
from pyspark.sql import functions as F

from cueline.catalog.monitoring import stream_blocks as blocks_of_table
from cueline.operators.folds import build_blocks, number_blocks
from cueline.streaming import keyed
from cueline.streaming.keyed import stream_blocks, stream_tickets

DAY = 86_400_000
CUES = "session_id bigint, idx bigint, speaker string, text string, start_ms bigint, end_ms bigint"


def cues(seed=4):
    r = random.Random(seed)
    rows = []
    for session in range(6):
        at = 0
        for idx in range(60 if session else 200):  # one session has most of the rows
            at += r.randrange(1, 2500)
            rows.append((session, idx, r.choice(["a", "a", "a", "b", None]), f"t{idx} ", at, at + r.randrange(100, 2500)))
    return rows


class Feed:
    """A folder that a stream reads one file a batch, with its output and checkpoint; every run is a restart."""

    def __init__(self, spark, folder, schema):
        self.spark, self.base, self.schema, self.n = spark, f"{folder}/{uuid.uuid4().hex}", schema, 0

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").json(f"{self.base}/in/{self.n:03d}")
        self.n += 1

    def run(self, build):
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(f"{self.base}/in")
        query = (
            build(stream)
            .writeStream.format("parquet")
            .option("path", f"{self.base}/out")
            .option("checkpointLocation", f"{self.base}/state")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        self.held = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        self.late = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress if p["stateOperators"])
        return self.spark.read.parquet(f"{self.base}/out")


def in_batches(rows, n, reach, seed):
    """The rows by time, each moved by less than ``reach``, in n files of any size."""
    r = random.Random(seed)
    moved = sorted(rows, key=lambda row: row[4] + r.randrange(reach))
    cuts = sorted(r.sample(range(1, len(moved)), n - 1))
    return [moved[a:b] for a, b in zip([0, *cuts], [*cuts, len(moved)], strict=True)]


def blocks_of(stream):
    at = stream.withColumn("at", F.timestamp_millis(F.col("start_ms") + DAY)).withWatermark("at", "5 seconds")
    return stream_blocks(at, 1200, 6000)


def test_blocks_of_any_cut_are_those_of_the_table(spark, tmp_path, rows):
    told = cues()
    want = rows(build_blocks(spark.createDataFrame(told, CUES), 1200, 6000), "session_id", "block_id", "start_ms", "end_ms", "speaker", "text", "cue_idx")
    # a cue of the far future carries the watermark past all others
    end = (99, 0, "x", "end", 10 * DAY, 10 * DAY + 1)
    for n, seed in ((2, 1), (5, 2)):
        feed = Feed(spark, os.fspath(tmp_path), CUES)
        parts = in_batches(told, n, 5000, seed)
        for part in parts[: n // 2]:
            feed.put(part)
        feed.run(blocks_of)
        for part in [*parts[n // 2 :], [end]]:
            feed.put(part)
        found = number_blocks(feed.run(blocks_of))
        assert rows(found, "session_id", "block_id", "start_ms", "end_ms", "speaker", "text", "cue_idx") == want
        # what is left is the one cue of the future and its timer
        assert feed.held <= 6
    feed.put([(0, 999, "a", "late", 5, 6)])
    assert feed.run(blocks_of).count() == len(want) and feed.late >= 1


def test_a_table_may_be_a_folder_of_files(spark, tmp_path, rows):
    told = spark.createDataFrame([(c, t, "user", f"t{t} ") for c in range(5) for t in range(9)], "conv_id bigint, turn bigint, role string, text string")
    told.repartition(3).write.parquet(f"{tmp_path}/folder/conversations.parquet")
    told.coalesce(1).write.parquet(f"{tmp_path}/parts")
    (tmp_path / "file").mkdir()
    (part,) = (tmp_path / "parts").glob("*.parquet")
    part.rename(tmp_path / "file" / "conversations.parquet")
    want = rows(blocks_of_table(spark, f"{tmp_path}/file"))
    assert want and rows(blocks_of_table(spark, f"{tmp_path}/folder")) == want


def test_tickets_are_closed_once_or_lapse(spark, tmp_path, rows):
    r = random.Random(7)
    schema = "n bigint, session string, stage string, status string, ms bigint, detail string"
    told = [(i, f"s{r.randrange(3)}", f"g{r.randrange(2)}", r.choice(["fail", "fail", "pass", "warn"]), 1000 * r.randrange(4000), f"e{i}") for i in range(240)]
    keep = 600_000
    want = []
    for _, session, stage, status, ms, detail in told:
        if status == "fail":
            closing = [x[4] for x in told if x[1:4] == (session, stage, "pass") and ms <= x[4] <= ms + keep]
            want.append((stage, session, detail, "closed" if closing else "open", ms, min(closing, default=None)))

    def tickets(stream):
        runs = stream.withColumn("ts", F.timestamp_millis(F.col("ms") + DAY)).withWatermark("ts", "1 minute")
        return stream_tickets(runs, "10 minutes")

    feed = Feed(spark, os.fspath(tmp_path), schema)
    parts = in_batches(told, 4, 60_000, 3)
    for part in parts[:2]:
        feed.put(part)
    feed.run(tickets)
    for part in [*parts[2:], [(999, "z", "z", "pass", 100 * DAY, "")]]:
        feed.put(part)
    found = feed.run(tickets).select(
        "source", "session", "issue", "status", (F.unix_millis("ts") - DAY).alias("ms"), (F.unix_millis("closed_ts") - DAY).alias("closed")
    )
    assert rows(found) == sorted(want, key=lambda row: [(v is not None, v) for v in row])


class Store:
    """The state of one key, and how often it was called."""

    def __init__(self):
        self.map, self.value, self.timers, self.calls, self.watermark = {}, None, set(), 0, 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            return getattr(self, f"do_{name}")(*args)

        return call

    def do_getMapState(self, *_):
        return self

    do_getValueState = do_getMapState

    def do_updateValue(self, key, value):
        self.map[key] = value

    def do_iterator(self):
        return iter(list(self.map.items()))

    def do_get(self):
        return self.value

    def do_update(self, value):
        self.value = value

    def do_clear(self):
        self.map.clear()

    def do_registerTimer(self, at):
        self.timers.add(at)

    def do_deleteTimer(self, at):
        self.timers.discard(at)

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_rows_of_a_key_are_held_by_few_calls(spark):
    """the rows a batch brings for a key go to its state and come back as a whole, large keys in chunks."""
    processor = keyed._Tickets(10**9)
    processor.names = ["source", "session", "at_ms", "issue", "status", "closed_ms"]
    for n in (40, 3 * keyed.CHUNK_ROWS):
        store = Store()
        processor.init(store)
        runs = [Row(at_ms=1 + (i * 7919) % n, place=0, closes=False, issue=f"e{i}") for i in range(n)]
        assert not list(processor.handleInputRows(("a", "b"), runs, store))
        assert store.calls < 12 and store.timers == {1} and len(store.map) == -(-n // keyed.CHUNK_ROWS)
        store.watermark = n
        assert not list(processor.handleInputRows(("a", "b"), [Row(at_ms=n + 5, place=1, closes=True, issue="")], store))
        assert store.calls < 24 and len(store.value[0]) == n and store.timers == {n + 5}
        store.watermark = n + 5
        closed = list(processor.handleExpiredTimer(("a", "b"), store, None))
        assert [r.at_ms for r in closed] == sorted(r.at_ms for r in runs) and {r.closed_ms for r in closed} == {n + 5}
        assert not store.map and not store.timers and store.calls < 36
