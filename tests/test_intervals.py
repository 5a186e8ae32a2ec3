"""Interval algebra against plain loops on random intervals, plus its edge rules."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cueline.operators import intervals as iv
from cueline.operators import speakers as sp


def make(seed, n, span=4000, longest=700):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a = rng.randrange(span)
        out.append((rng.choice([0, 0, 0, 1]), i, a, a + rng.randrange(0, longest)))
    return out


SCHEMA = "session_id int, idx int, start_ms bigint, end_ms bigint"


def union(spans, gap, inclusive=False):
    out = []
    for a, b in sorted(s for s in spans if s[1] > s[0]):
        step = a - out[-1][1] if out else None
        if out and (step < gap or (inclusive and step == gap)):
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("gap,inclusive,chunk", [(0, False, 50), (40, False, 300), (0, True, 10**6), (25, True, 90)])
def test_merge(spark, gap, inclusive, chunk):
    data = make(1, 60)
    df = spark.createDataFrame(data, SCHEMA)
    out = iv.merge_intervals(df, min_gap_ms=gap, inclusive=inclusive, chunk_ms=chunk)
    for s in (0, 1):
        mine = sorted((r.start_ms, r.end_ms) for r in out.collect() if r.session_id == s)
        assert mine == union([(a, b) for q, _, a, b in data if q == s], gap, inclusive)
        assert all(x[1] <= y[0] for x, y in zip(mine, mine[1:]))


@pytest.mark.parametrize("least", [0, 60])
def test_subtract_conserves_time(spark, least):
    keep, drop = make(2, 40), make(3, 40)
    out = iv.subtract_intervals(
        spark.createDataFrame(keep, SCHEMA),
        spark.createDataFrame(drop, SCHEMA),
        min_frag_ms=least,
        bin_ms=130,
        chunk_ms=200,
        key=["idx"],
    ).collect()
    for s, i, a, b in keep:
        removed = union([(x, y) for q, _, x, y in drop if q == s], 0)
        pieces, at = [], a
        for x, y in removed:
            if y <= at or x >= b:
                continue
            pieces.append((at, x))
            at = max(at, y)
        pieces.append((at, b))
        wanted = sorted(p for p in pieces if p[1] > p[0] and p[1] - p[0] >= least)
        assert sorted((r.start_ms, r.end_ms) for r in out if r.idx == i) == wanted


@pytest.mark.parametrize("bin_ms,heavy", [(50, 2), (900, 3), (10**6, 1), (300, 10**6)])
def test_interval_join_with_spread_bins(spark, bin_ms, heavy):
    left, right = make(4, 50), make(5, 50)
    pairs = iv.interval_join(
        spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), bin_ms=bin_ms, heavy_rows=heavy
    )
    mine = sorted((r.idx, r.r_idx) for r in pairs.collect())
    wanted = sorted((i, j) for s, i, a, b in left for q, j, x, y in right if s == q and a < y and b > x)
    assert mine == wanted


def test_gap_uses_last_row_and_pause_uses_running_end(spark, rows):
    data = [(0, 0, "B1", 0, 9000), (0, 1, "B2", 1000, 2000), (0, 2, "B3", 5000, 6000), (0, 3, "B4", 10000, 10500)]
    df = spark.createDataFrame(data, "session_id int, idx int, block_id string, start_ms bigint, end_ms bigint")
    assert rows(iv.find_gaps(df), "start_ms", "end_ms", "before") == [(2000, 5000, "B3"), (6000, 10000, "B4")]
    assert rows(iv.collapsible_pauses(df), "start_ms", "end_ms") == [(9000, 10000)]
    first = spark.createDataFrame([(0, 0, "B1", 2000, 2500)], df.schema)
    assert rows(iv.find_gaps(first), "start_ms", "end_ms") == [(0, 2000)]


def narrow(s, words, pad=50):
    lo, hi = s
    for a, b in sorted(words):
        if b <= lo or a >= hi:
            continue
        if a <= lo:
            lo = max(lo, b + pad)
        elif b >= hi:
            hi = min(hi, a - pad)
        else:
            return None
    return (lo, hi) if hi > lo else None


def test_clamp_narrows_one_word_at_a_time(spark):
    silences, words = make(6, 30, longest=900), make(7, 30, longest=160)
    out = iv.clamp_to_words(
        spark.createDataFrame(silences, SCHEMA).drop("idx"), spark.createDataFrame(words, SCHEMA), bin_ms=200
    ).collect()
    for r in out:
        near = [(a, b) for q, _, a, b in words if q == r.session_id]
        hit = [w for w in near if w[0] < r.end_ms and w[1] > r.start_ms]
        wanted = narrow((r.start_ms, r.end_ms), hit)
        assert (r.lo_ms, r.hi_ms) == (wanted or (None, None))


def test_snap_and_tighten(spark, rows):
    ranges = spark.createDataFrame([(0, 0, 1000, 9000)], SCHEMA)
    silences = spark.createDataFrame([(0, 0, 800, 1100), (0, 1, 3000, 6000), (0, 2, 8900, 12000)], SCHEMA)
    words = spark.createDataFrame([(0, 0, 2500, 3200)], SCHEMA)
    snapped = iv.snap_boundaries(ranges, silences, words)
    # the start goes to the middle of a short silence, the end near a long one
    assert rows(snapped, "start_ms", "end_ms") == [(950.0, 9020.0)]
    cut = iv.tighten_pauses(ranges, silences.drop("idx"), words)
    # clamped to 3250..6000, shortened to 600
    assert rows(cut, "start_ms", "end_ms") == [(3550, 5700)]


def test_word_guard(spark, rows):
    ranges = spark.createDataFrame([(0, 0, 1050, 2050)], SCHEMA)
    words = spark.createDataFrame([(0, 0, 1000, 1100), (0, 1, 2000, 2100)], SCHEMA)
    assert rows(iv.word_guard(ranges, words), "start_ms", "end_ms") == [(980, 2120)]


def test_asof_remap(spark, rows):
    cut_map = spark.createDataFrame(
        [(0, 1000, 2000, 0), (0, 5000, 6000, 1000)],
        "session_id int, src_start_ms bigint, src_end_ms bigint, dst_start_ms bigint",
    )
    points = spark.createDataFrame([(0, i, t) for i, t in enumerate([0, 1500, 3000, 5000, 6000])], "session_id int, idx int, t_ms bigint")
    out = iv.asof_remap(points, cut_map, tempo=2.0, chunk_ms=700)
    assert rows(out, "idx", "dst_ms") == [(0, 0.0), (1, 250.0), (2, 1000.0), (3, 1000.0), (4, None)]


def test_overlap_ties_and_fallbacks(spark, rows):
    turns = spark.createDataFrame(
        [(0, 0, 0, 1000, "A"), (0, 1, 1000, 2000, "B"), (0, 2, 9000, 9500, "C")],
        "session_id int, turn_idx int, start_ms bigint, end_ms bigint, speaker string",
    )
    cues = spark.createDataFrame(
        [(0, 0, 500, 1500, None), (0, 1, 4000, 4200, None), (0, 2, 7000, 7200, None), (1, 0, 0, 10, None)],
        "session_id int, idx int, start_ms bigint, end_ms bigint, speaker string",
    )
    out = sp.assign_by_max_overlap(cues, turns)
    assert rows(out, "session_id", "idx", "speaker", "overlap_ms") == [
        (0, 0, "A", 500),
        (0, 1, "B", 0),
        (0, 2, "C", 0),
        (1, 0, "S1", 0),
    ]


def test_words_inherit_the_previous_label(spark, rows):
    turns = spark.createDataFrame(
        [(0, 0, 1000, 2000, "A"), (0, 1, 3000, 4000, "B")],
        "session_id int, turn_idx int, start_ms bigint, end_ms bigint, speaker string",
    )
    words = spark.createDataFrame(
        [(0, 0, p, t, t + d) for p, (t, d) in enumerate([(2900, 0), (3100, 50), (3500, 0), (9000, 10)])],
        "session_id int, idx int, pos int, start_ms bigint, end_ms bigint",
    )
    assert rows(sp.label_words(words, turns), "pos", "label") == [(0, "B"), (1, "B"), (2, "B"), (3, "B")]


def test_split_at_speaker_change_and_glue(spark, rows):
    cues = spark.createDataFrame(
        [(0, 0, 0, 1000, "ab cd", None), (0, 1, 1000, 2000, "ef", None)],
        "session_id int, idx int, start_ms bigint, end_ms bigint, text string, speaker string",
    )
    turns = spark.createDataFrame(
        [(0, 0, 0, 500, "A"), (0, 1, 500, 2000, "B")],
        "session_id int, turn_idx int, start_ms bigint, end_ms bigint, speaker string",
    )
    words = spark.createDataFrame(
        [(0, 0, 0, 100, 400, "ab"), (0, 0, 1, 600, 900, "cd"), (0, 1, 0, 1100, 1500, "ef")],
        "session_id int, idx int, pos int, start_ms bigint, end_ms bigint, word string",
    )
    out = sp.split_at_speaker_change(cues, turns, words)
    # the second part and the next cue are one speaker and split a plain word
    assert rows(out, "start_ms", "end_ms", "speaker", "text") == [(0, 400, "A", "ab"), (600, 2000, "B", "cdef")]


def test_parts_of_cues_are_numbered_in_one_order(spark, rows, monkeypatch):
    """F32: no scan goes over the words cue by cue; cues with several parts, one part and no word."""
    cues = spark.createDataFrame(
        [(0, 0, 0, 1000, "aa bb cc", "X"), (0, 1, 2000, 3000, "zz", "X"), (0, 2, 4000, 5000, "one  kept", "X")],
        "session_id int, idx int, start_ms bigint, end_ms bigint, text string, speaker string",
    )
    turns = spark.createDataFrame(
        [(0, 0, 0, 350, "A"), (0, 1, 350, 650, "B"), (0, 2, 650, 3000, "A"), (0, 3, 4000, 5000, "B")],
        "session_id int, turn_idx int, start_ms bigint, end_ms bigint, speaker string",
    )
    words = spark.createDataFrame(
        [(0, 0, 0, 0, 300, "aa"), (0, 0, 1, 400, 600, "bb"), (0, 0, 2, 640, 900, "cc"), (0, 2, 0, 4000, 4200, "one"), (0, 2, 1, 4500, 4700, "kept")],
        "session_id int, idx int, pos int, start_ms bigint, end_ms bigint, word string",
    )
    scanned = []
    for name in ("scan", "with_neighbours"):
        found = getattr(sp, name)
        monkeypatch.setattr(sp, name, lambda df, by, *a, found=found, **o: (scanned.extend(by), found(df, by, *a, **o))[1])
    out = sp.split_at_speaker_change(cues, turns, words)
    assert rows(out, "idx", "start_ms", "end_ms", "speaker", "text") == [
        (1, 0, 300, "A", "aa"),
        (2, 400, 600, "B", "bb"),
        (3, 640, 1000, "A", "cc"),
        (4, 2000, 3000, "X", "zz"),
        (5, 4000, 5000, "B", "one  kept"),
    ]
    assert scanned and set(scanned) == {"session_id"}


def test_runs_and_closing(spark, rows):
    frames = spark.createDataFrame(
        [(0, "A", f, f in (1, 2, 3, 5, 6, 12)) for f in range(15)], "session_id int, track string, f int, on boolean"
    )
    runs = iv.runs_of(frames, F.col("on"), chunk_frames=4)
    assert rows(runs, "start_ms", "end_ms") == [(10, 40), (50, 70), (120, 130)]
    assert rows(iv.close_and_filter_runs(runs, gap_ms=20, min_ms=20), "start_ms", "end_ms") == [(10, 70)]
