"""Playing order without replays, against a plain loop."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueline.operators import monotone as mo
from cueline.operators.scan import time_chunk
from cueline.operators.segments import capped_segments


def plain(segments, least):
    kept = []
    for seq, start, end in segments:
        if kept and kept[-1][1] < start < kept[-1][2]:
            start = kept[-1][2]
        if end - start >= least:
            kept.append((seq, start, end))
    return kept


def drawn(rng, n, step, back, longest):
    at, out = 0, []
    for seq in range(n):
        at += rng.randrange(step)
        start = max(0, at - rng.randrange(1, back)) if rng.random() < 0.3 else at
        out.append((seq, start, start + rng.randrange(1, longest)))
    return out


@pytest.mark.parametrize("step,back,longest", [(40, 2, 30), (9, 60, 40), (3, 200, 90), (2, 30, 400), (1, 12, 24)])
def test_rules_of_blocks_give_the_state_of_a_loop(step, back, longest):
    rng = random.Random(step * 1000 + back)
    for _ in range(120):
        least = rng.choice([1, 5, 12])
        segments = [x for x in drawn(rng, 120, step, back, longest) if x[2] - x[1] >= least]
        size, state, reach, got = rng.choice([1, 2, 5, 17]), (mo.NEVER, mo.NEVER), mo.NEVER, []
        for at in range(0, len(segments), size):
            part = segments[at : at + size]
            block = mo.Block(np.array([s for _, s, _ in part]), np.array([e for *_, e in part]), least)
            rows, starts = block.replay(*state)
            got += [(part[r][0], s, part[r][2]) for r, s in zip(rows, starts, strict=True)]
            state = mo.after(block.rules(reach), *state)
            assert state == (got[-1][1:] if got else (mo.NEVER, mo.NEVER))
            reach = max(reach, *(e for *_, e in part))
        assert got == plain(segments, least)


def test_enforce_monotonic(spark):
    rng = random.Random(5)
    rows = []
    for session, n in ((1, 700), (2, 90), (3, 1)):
        rows += [(session, *x, "speech", False, f"t{x[0]}") for x in drawn(rng, n, 6, 150, 500)]
    odd = [(1, 9000, 5, None, "speech", False, "x"), (1, 9001, None, 9, "speech", False, "x"), (4, 1, 7, 8, "music", False, None), (4, 2, 7, 8, "speech", True, None), (4, 3, 7, 8, None, None, None)]
    df = spark.createDataFrame(rows + odd, "session_id int, seq int, start_ms bigint, end_ms bigint, kind string, clip boolean, note string")
    want = [(s, *x) for s in (1, 2, 3) for x in plain([r[1:4] for r in rows if r[0] == s], 120)] + [(4, k, 7, 8) for k in (1, 2, 3)]
    for size in (7, 4096):
        out = mo.enforce_monotonic(df, rows=size)
        assert out.schema == df.schema or out.columns == df.columns
        assert sorted((r.session_id, r.seq, r.start_ms, r.end_ms) for r in out.collect()) == sorted(want)
    assert mo.enforce_monotonic(df.limit(0)).count() == 0


def test_a_chain_of_overlaps_makes_few_rules(spark):
    # each of 20 000 segments overlaps the one before
    n = 20_000
    df = spark.range(n).select(
        F.lit(1).alias("session_id"), F.col("id").alias("seq"), F.lit("speech").alias("kind"), F.lit(False).alias("clip"),
        (F.col("id") * 200).alias("start_ms"), (F.col("id") * 200 + 500).alias("end_ms"),
    )
    block = mo.Block(np.arange(4096) * 200 + 8_192_000, np.arange(4096) * 200 + 8_192_500, 120)
    assert len(block.rules(8_192_300)) < 12
    got = sorted((r.seq, r.start_ms, r.end_ms) for r in mo.enforce_monotonic(df).collect())
    assert got == plain([(i, i * 200, i * 200 + 500) for i in range(n)], 120)


@pytest.fixture()
def late_broadcasts(spark):
    """Joins planned over shuffles and broadcast when their size is known, as on large tables; files are read one by one."""
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "20k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.files.openCostInBytes": "64m",
    }
    before = {c: spark.conf.get(c, None) for c in wanted}
    for c, value in wanted.items():
        spark.conf.set(c, value)
    yield
    for c, value in before.items():
        spark.conf.unset(c) if value is None else spark.conf.set(c, value)


def test_blocks_stay_whole_behind_a_late_broadcast(spark, late_broadcasts):
    rng = random.Random(8)
    rows = {s: [(10 * q, a, b) for q, a, b in drawn(rng, 600, 6, 150, 500)] for s in range(6)}
    df = spark.createDataFrame([(s, *x) for s in rows for x in rows[s]], "session_id int, seq int, start_ms bigint, end_ms bigint")
    speech = df.withColumn("kind", F.lit("speech")).withColumn("clip", F.lit(False))
    out = mo.enforce_monotonic(speech, rows=100).select("session_id", "seq", "start_ms", "end_ms")
    assert sorted(map(tuple, out.collect())) == sorted((s, *x) for s in rows for x in plain(rows[s], 120))

    cut = capped_segments(df, "session_id", ["seq"], time_chunk("seq", 100), F.lit(False), F.col("end_ms"), F.col("start_ms"), 700, rows=100)
    want = []
    for s in rows:
        low = None
        for pos, (seq, start, end) in enumerate(rows[s], 1):
            if low is None or end - low > 700:
                low, opened = start, pos
            want.append((s, seq, opened))
    assert sorted(map(tuple, cut.select("session_id", "seq", "segment").collect())) == sorted(want)
