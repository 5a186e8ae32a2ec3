"""Cells, masks and time: invariants on random plans, and small worked cases."""

from __future__ import annotations

import random

import pytest

from cueline.operators import cells as ce

BLOCK = "session_id int, track string, block_id string, start_ms bigint, end_ms bigint, keep boolean"


def plan(seed):
    rng = random.Random(seed)
    rows = []
    for track in "AB":
        at = 0
        for i in range(12):
            at += rng.randrange(50, 1600)
            end = at + rng.randrange(200, 2500)
            rows.append((0, track, f"{track}{i}", at, end, rng.random() < 0.7))
            at = end
    return rows


def states(cells):
    return [(r.a_ms, r.b_ms, {s.track: s.state for s in r.states}) for r in sorted(cells.collect(), key=lambda r: r.a_ms)]


@pytest.mark.parametrize("seed", [1, 2])
def test_overlay_invariants(spark, seed):
    blocks = spark.createDataFrame(plan(seed), BLOCK)
    none = spark.createDataFrame([], "session_id int, track string, block_id string, start_ms bigint, end_ms bigint")
    cuts = spark.createDataFrame([(0, 3000, 3400)], "session_id int, start_ms bigint, end_ms bigint")
    gaps = spark.createDataFrame([], "session_id int, start_ms bigint, end_ms bigint, keep boolean")
    long = ce.atomic_cells(blocks, none, cuts, gaps, bin_ms=700, chunk_ms=900)
    assert ce.conflict_check(long).isEmpty()
    wide = ce.to_wide(long)
    before = states(wide)
    assert all(x[1] == y[0] for x, y in zip(before, before[1:]))
    for a, b, by_track in before:
        for track, state in by_track.items():
            inside = [r for r in plan(seed) if r[1] == track and r[3] < b and r[4] > a]
            wanted = "silent" if 3000 <= a < 3400 else ("keep" if inside[0][5] else "silent") if inside else "duck"
            assert state == wanted
    masked = ce.activity_mask(wide, chunk_ms=900)
    after = states(masked)
    assert all(x[1] == y[0] for x, y in zip(after, after[1:]))

    def at(table, t):
        return next(s for a, b, s in table if a <= t < b)

    for a, b, s in before:
        for t in range(a, b, 97):
            now = at(after, t)
            for track, state in s.items():
                # only ducked time may open
                assert now[track] == state or (state == "duck" and now[track] == "keep")
    kept = states(ce.resolve_time(masked, bin_ms=700, chunk_ms=900))
    for a, b, s in kept:
        assert "keep" in s.values() or "silent" not in s.values()
    ranges = ce.retained_ranges(ce.resolve_time(masked)).collect()
    gains = ce.gain_envelope(ce.resolve_time(masked)).collect()
    total = sum(r.end_ms - r.start_ms for r in ranges)
    for track in "AB":
        assert sum(g.bus_end_ms - g.bus_start_ms for g in gains if g.track == track) == total


def test_strike_conflict_and_gap(spark, rows):
    blocks = spark.createDataFrame([(0, "A", "a1", 0, 1000, True), (0, "A", "a2", 900, 1200, False)], BLOCK)
    strikes = spark.createDataFrame([(0, "A", "a1", 200, 400)], "session_id int, track string, block_id string, start_ms bigint, end_ms bigint")
    cuts = spark.createDataFrame([], "session_id int, start_ms bigint, end_ms bigint")
    gaps = spark.createDataFrame([(0, 1200, 1500, True)], "session_id int, start_ms bigint, end_ms bigint, keep boolean")
    out = ce.atomic_cells(blocks, strikes, cuts, gaps)
    assert rows(out, "a_ms", "b_ms", "state") == [
        (0, 200, "keep"),
        (200, 400, "silent"),
        (400, 900, "keep"),
        (900, 1000, "conflict"),
        (1000, 1200, "silent"),
        (1200, 1500, "keep"),
    ]


def test_overlay_of_a_dense_session_is_linear(spark):
    """Blocks of two tracks that nearly all overlap: what is shuffled grows with the edges, not with the pairs."""
    rng = random.Random(3)
    rows = [(0, "ab"[i % 2], f"x{i}", a := rng.randrange(45_000), a + rng.randrange(1, 45_000), rng.random() < 0.6) for i in range(2000)]
    gap_rows = [(0, 0, 90_000, True), (0, 10, 80, False), (0, 200_000, 200_500, False), (0, 200_000, 201_000, True)]
    blocks = spark.createDataFrame(rows, BLOCK)
    none = spark.createDataFrame([], "session_id int, track string, block_id string, start_ms bigint, end_ms bigint")
    cuts = spark.createDataFrame([(0, 3000, 3400), (0, 3300, 3500)], "session_id int, start_ms bigint, end_ms bigint")
    gaps = spark.createDataFrame(gap_rows, "session_id int, start_ms bigint, end_ms bigint, keep boolean")
    found = ce.atomic_cells(blocks, none, cuts, gaps, chunk_ms=900).collect()
    edges = sorted({t for r in rows for t in r[3:5]} | {3000, 3400, 3300, 3500} | {t for g in gap_rows for t in g[1:3]})
    want = set()
    for a, b in zip(edges, edges[1:]):
        for track in "ab":
            kinds = {r[5] for r in rows if r[1] == track and r[3] <= a and r[4] >= b}
            gap = next((g[3] for g in sorted(gap_rows) if g[1] <= a and g[2] >= b), None)
            state = "conflict" if len(kinds) > 1 else "keep" if True in kinds else "silent" if kinds else {True: "keep", False: "silent", None: "duck"}[gap]
            want.add((a, b, track, "silent" if 3000 <= a < 3500 else state))
    assert {(r.a_ms, r.b_ms, r.track, r.state) for r in found} == want and len(found) == len(want)
