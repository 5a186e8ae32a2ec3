"""Texts that stand nowhere in their transcript, against ``in``."""

from __future__ import annotations

import random

import pytest

from cueline.plans.editing import _spans, not_in_transcript


@pytest.mark.parametrize("letters,size", [("ab", 64), ("abcdé只", 64), ("abcdefghij", 4096)])
def test_not_in_transcript(spark, letters, size):
    rng = random.Random(len(letters))
    cues, texts, want = [], [], set()
    for session, n in ((1, 60), (2, 3), (3, 1)):
        said = ["".join(rng.choices(letters, k=rng.randrange(0, 14))) for _ in range(n)] + ["a"]
        cues += [(session, i, " ".join(t)) for i, t in enumerate(said)]
        flat = "".join(said)
        for k in range(60):
            a = rng.randrange(len(flat))
            t = flat[a : a + rng.choice([1, 3, 11, 12, 23, 24, 25, 60, 300])]
            if rng.random() < 0.4:
                at = rng.randrange(len(t))
                t = t[:at] + rng.choice(letters) + t[at + 1 :]
            texts.append((session, f"B{k}", t))
            if t and t not in flat:
                want.add((session, f"B{k}"))
        texts += [(session, "whole", flat), (session, "more", flat + "b"), (session, "none", "")]
        want.add((session, "more"))
    texts.append((9, "B0", "no such session"))
    want.add((9, "B0"))
    cue = spark.createDataFrame(cues, "session_id int, idx int, text string")
    text = spark.createDataFrame(texts, "session_id int, block_id string, flat string")
    found = not_in_transcript(text, cue, ["session_id"], ["session_id", "block_id"], size=size)
    assert {tuple(r) for r in found.collect()} == want


def test_a_long_text_is_cut_before_it_is_compared(spark):
    """No row of the comparison holds more of a text than one chunk of the transcript."""
    text = spark.createDataFrame([(1, "B0", "abcdefghij" * 500, 7)], "session_id int, block_id string, flat string, at bigint")
    pieces = _spans(text, 64).orderBy("chunk").collect()
    assert "".join(r["own"] for r in pieces) == "abcdefghij" * 500
    assert (pieces[0]["from"], pieces[1]["from"]) == (7, 0)
    assert max(len(r["own"]) for r in pieces) == 64 and "flat" not in pieces[0].asDict()
