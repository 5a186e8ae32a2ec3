from __future__ import annotations

import math

import pytest

from cueline.operators import tracks as tr


def test_crosstalk_of_two_tracks_and_of_one(spark, rows):
    """A session with one track has no gains; it shows its own noise and isn't dropped."""
    frames = spark.createDataFrame(
        [(0, "A", 1, -10.0), (0, "B", 1, -30.0), (0, "B", 2, -20.0), (1, "A", 1, -10.0)],
        "session_id int, track string, f bigint, level_db double",
    )
    gains = spark.createDataFrame(
        [(0, "A", "B", -6.0), (0, "B", "A", -12.0)], "session_id int, track string, source string, gain_db double"
    )
    noise = spark.createDataFrame([(0, "A", -50.0), (0, "B", -40.0), (1, "A", -45.0)], "session_id int, track string, noise_db double")
    out = rows(tr.predict_crosstalk(frames, gains, noise), "session_id", "track", "f", "predicted_db")

    def db(*levels):
        return pytest.approx(10 * math.log10(sum(10 ** (x / 10) for x in levels)))

    assert out == [(0, "A", 1, db(-50, -36)), (0, "B", 1, db(-40, -22)), (0, "B", 2, db(-40)), (1, "A", 1, db(-45))]


def test_levels_by_frame_over_chunks(spark):
    """Loudest first, ties by track, whatever the chunk."""
    data = [(s, t, f, float((s + 3 * f * (1 + ord(t))) % 7)) for s in range(3) for t in "CAB" for f in range(1, 30) if (f + ord(t)) % 5]
    frames = spark.createDataFrame(data, "session_id int, track string, f bigint, level_db double")
    out = {(r.session_id, r.f): [tuple(x) for x in r.levels] for r in tr.levels_by_frame(frames, chunk_frames=4).collect()}
    want = {}
    for s, t, f, v in data:
        want.setdefault((s, f), []).append((t, v))
    assert out == {key: sorted(levels, key=lambda x: (-x[1], x[0])) for key, levels in want.items()}
