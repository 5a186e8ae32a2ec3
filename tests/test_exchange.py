"""Files written and read back, and the run log as a stream."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from cueline.operators import figures as fg
from cueline.sources import captions as ca
from cueline.sources import planfiles as pf
from cueline.streaming import runs as ru


def test_srt_files(spark, tmp_path, rows):
    (tmp_path / "one.srt").write_text(
        "1\n00:00:01,000 --> 00:00:02,500\n[S1] hello\nthere\n\n00:00:03.5 --> 00:00:04,000\nplain\n\nnot a cue\n\n4\n00:00:05,000 --> 00:00:06,000\n[a name that is far too long for one] x\n",
        encoding="utf-8",
    )
    got = rows(ca.read_srt(spark, str(tmp_path / "*.srt")), "session_id", "idx", "start_ms", "end_ms", "text", "speaker")
    assert got == [
        ("one", 1, 1000, 2500, "hello\nthere", "S1"),
        ("one", 2, 3500, 4000, "plain", None),
        ("one", 3, 5000, 6000, "[a name that is far too long for one] x", None),
    ]
    cues = ca.read_srt(spark, str(tmp_path / "one.srt"))
    ca.write_srt(cues, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out" / "session_id=one").glob("part-*"))
    text = "".join(p.read_text(encoding="utf-8") for p in parts)
    assert text.startswith("1\n00:00:01,000 --> 00:00:02,500\n[S1] hello\nthere\n\n2\n")


def test_vtt_words_and_prosody(spark, tmp_path, rows):
    (tmp_path / "v.vtt").write_text(
        "WEBVTT\nKind: captions\n\n00:00:01.000 --> 00:00:02.000\nold line\n<c>new</c> line\n\n00:00:02.000 --> 00:00:03.000\nnew line\n\n00:00:03.000 --> 00:00:04.000\nlast\n"
    )
    assert rows(ca.read_vtt(spark, str(tmp_path / "v.vtt")), "clock", "text") == [("00:00:01", "new line"), ("00:00:03", "last")]
    (tmp_path / "w.json").write_text(json.dumps([{"start": 0.1, "end": 0.25, "word": "a"}, {"start": 1, "end": 4.5, "word": "b"}]))
    assert rows(ca.read_words(spark, str(tmp_path / "w.json")), "pos", "start_ms", "end_ms", "word") == [(0, 100, 250, "a")]
    (tmp_path / "p.json").write_text('{"silences": [{"start": 0.5, "end": 1.25}], "segments": [{"idx": 1, "start": 0, "end": 2, "f0_p75": NaN, "rms_db": -20.5}]}')
    silences, segments = ca.read_prosody(spark, str(tmp_path / "p.json"))
    assert rows(silences, "start_ms", "end_ms") == [(500, 1250)]
    assert rows(segments, "idx", "rms_db", "f0_p75") == [(1, -20.5, None)]


def test_plan_file(spark, tmp_path):
    (tmp_path / "plan.md").write_text(
        "# Cutplan — x\n## Cutplan note\n## ⚙ max-pause=0.9 clip-gap=0.5\n## 🎬 best\n- [x] B0001 [0:00–0:05] [S1] a ~~b~~ c ← why ← not\n## 🎵 opening fadein=2\n"
        "## ➕ take.wav gain=+3 start=1.5 from home\n- [ ] S0001 [0:00–0:03] extra\n## ✂ 1:02.5-70 cough\n## Chapter one\n- [X] B0002 [0:05–0:09] plain\n",
        encoding="utf-8",
    )
    got = {r.seq: r for r in pf.read_plan(spark, str(tmp_path / "plan.md")).collect()}
    kinds = [got[s].kind for s in sorted(got)]
    assert kinds == ["config", "block", "music", "insert", "block", "cut", "chapter", "block"]
    clip, music, insert, extra, cut, chapter, last = [got[s] for s in sorted(got)][1:]
    assert (clip.block_id, clip.keep, clip.raw, clip.clip) == ("B0001", True, "a ~~b~~ c ← why", True)
    assert (music.name, music.params) == ("opening", {"fadein": "2"})
    assert (insert.name, insert.note, insert.params) == ("take.wav", "from home", {"gain": "+3", "start": "1.5"})
    assert (extra.keep, extra.insert, extra.clip) == (False, "take.wav", False)
    assert (cut.a_ms, cut.b_ms, cut.note) == (62500, 70000, "cough")
    assert chapter.name == "Chapter one" and last.keep and last.insert is None


def test_run_log_stream(spark, tmp_path, rows):
    folder = tmp_path / "log"
    folder.mkdir()
    lines = [
        {"ts": f"2024-01-01T{h:02d}:{m:02d}:00Z", "session": "s", "stage": "x", "tool": "t", "status": st, "metrics": {"n": 1.0}, "detail": d}
        for h, m, st, d in [(1, 0, "pass", ""), (1, 5, "fail", "e"), (1, 6, "fail", "e"), (1, 50, "fail", "e"), (3, 0, "pass", "")]
    ]
    (folder / "a.jsonl").write_text("\n".join([*map(json.dumps, lines), '{"broken']) + "\n")
    log = ru.read_run_log(spark, str(folder))
    assert log.count() == 5
    assert rows(ru.fail_rate(log), "runs", "fails") == [(1, 0), (4, 3)]
    stream = ru.open_tickets(ru.read_run_log(spark, str(folder), streaming=True), "10 minutes")
    query = stream.writeStream.format("memory").queryName("tickets").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    tickets = spark.table("tickets")
    assert tickets.count() >= 1 and tickets.filter("status <> 'open'").isEmpty()
    closed = ru.close_tickets(ru.open_tickets(log), F.col("issue") == "e")
    assert closed.filter("status = 'closed' AND closed_ts IS NOT NULL").count() == 3


def test_similar_hashes_against_all_pairs(spark):
    import random

    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = set(base)
    for b in base:
        for _ in range(4):
            v = b
            for bit in rng.sample(range(64), rng.randrange(1, 9)):
                v ^= 1 << bit
            values.add(v)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    df = spark.createDataFrame([(0, v) for v in signed], "session_id int, hash bigint")
    for bands in (7, 8, 10):
        got = sorted((r.hash_a, r.hash_b) for r in fg.similar_hashes(df, bands=bands, heavy_rows=3).collect())
        mask = 2**64 - 1
        wanted = sorted((a, b) for a in signed for b in signed if a < b and bin((a ^ b) & mask).count("1") <= 6)
        assert got == wanted


def test_copies_are_not_paired_with_each_other(spark, rows):
    data = [(0, f"f{i:03d}", 7, ["a", "b"], i % 3 if i < 30 else 50) for i in range(40)]
    df = spark.createDataFrame(data, "session_id int, file string, hash bigint, terms array<string>, deck_page int")
    members, edges, review = fg.near_duplicates(df)
    assert edges.isEmpty() and review.count() == 1
    groups = fg.duplicate_groups(members, edges)
    assert groups.filter("duplicate_of IS NULL").count() == 2


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(0, f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)], "session_id int, a string, b string")
    roots = fg.connected_components(edges).select("root").distinct().collect()
    assert [r.root for r in roots] == ["n000"]
