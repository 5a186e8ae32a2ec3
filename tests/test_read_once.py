"""What is read several times is made once."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueline.catalog import collect
from cueline.operators import audits as au
from cueline.operators import figures as fg
from cueline.operators import intervals as iv
from cueline.operators import tracks as tr

SMOKE = "/root/testdata/sf0.001"


def test_frames_of_runs_are_numbered_once(spark):
    """the last frames and the hits come from one written table."""
    found = collect()[0]["silence_runs_to_last_frame"](spark, SMOKE)
    assert not any("lineitem" in f for f in found.inputFiles())


def test_windows_of_gaps_are_joined_once(spark, monkeypatch):
    """bursts, peaks and the level of a gap come from one written table."""
    seen = []
    merge = iv.merge_intervals
    monkeypatch.setattr(iv, "merge_intervals", lambda df, *a, **o: (seen.extend(df.inputFiles()), merge(df, *a, **o))[1])
    collect()[0]["classify_gaps"](spark, SMOKE)
    assert seen and not any("lineitem" in f or "conversations" in f for f in seen)


def test_frames_of_the_room_are_numbered_once(spark):
    """the spans and the mixed levels come from one written table."""
    found = collect()[0]["room_noise"](spark, SMOKE)
    assert not any("lineitem" in f for f in found.inputFiles())


def test_lines_of_the_gate_are_made_once(spark, monkeypatch):
    """F24 F26: the rules read one written table of lines, and the image lines are found once."""
    seen, widths = [], []
    found, width = fg.image_lines, au.residual_halfwidth
    monkeypatch.setattr(fg, "image_lines", lambda df, *a, **o: (seen.append(df.inputFiles()), found(df, *a, **o))[1])
    monkeypatch.setattr(au, "residual_halfwidth", lambda df, *a, **o: (widths.extend(df.inputFiles()), width(df, *a, **o))[1])
    collect()[0]["publish_gate_all_rules"](spark, SMOKE)
    assert len(seen) == 1
    assert widths and not any("documents" in f for f in seen[0] + widths)


def _levels_made(spark, monkeypatch, name):
    made, found = [], tr.levels_by_frame
    monkeypatch.setattr(tr, "levels_by_frame", lambda *a, **o: (made.append(1), found(*a, **o))[1])
    out = collect()[0][name](spark, SMOKE)
    assert not any("lineitem" in f for f in out.inputFiles())
    return len(made)


def test_tracks_of_a_frame_meet_once_for_crosstalk(spark, monkeypatch):
    """gains, noise and prediction read one written table of whole frames."""
    assert _levels_made(spark, monkeypatch, "predict_crosstalk") == 1


def test_tracks_of_a_frame_meet_once_for_events(spark, monkeypatch):
    """flags and leads come from the same written table, and frames meet their limit after the other rules."""
    judged, runs = [], tr.runs_of
    monkeypatch.setattr(tr, "runs_of", lambda df, *a, **o: (judged.append(df.columns), runs(df, *a, **o))[1])
    assert _levels_made(spark, monkeypatch, "unclaimed_events") == 1
    assert judged == [["session_id", "track", "f", "residual_db", "limit_db"]]


def test_only_hits_of_runs_are_written(spark, monkeypatch):
    """runs that end at the next frame don't need the frames beside them."""
    written, cut = [], iv.settle
    monkeypatch.setattr(iv, "settle", lambda df, *a: (written.append(df), cut(df, *a))[1])
    frames = spark.range(10).selectExpr("0 AS session_id", "'A' AS track", "id AS f", "id % 3 = 0 AS on")
    assert iv.runs_of(frames, F.col("on")).count() == 4
    assert written[0].columns == ["session_id", "track", "f"] and written[0].count() == 4
