"""Text rules on rows written for them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cueline.functions import clock as ck
from cueline.functions import text as tx
from cueline.operators import cleaning as cl


def apply(spark, values, fn, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(fn(F.col("v")).alias("r")).collect()]


def test_dictionary_counts_after_earlier_fixes(spark):
    pairs = tx.pairs_array([("ab", "b"), ("bb", "x")])
    out = apply(spark, ["abab", "bb", ""], lambda c: tx.apply_dictionary(c, pairs))
    assert [(r.text, r.hits) for r in out] == [("x", 3), ("x", 1), ("", 0)]


def test_cleaning_order(spark):
    texts = ["  因該  好的啊 ", "字幕由某人", "主題是,好", "主題是,今天天氣很好", "对", "abcdefghijkl mnop", "聽到 ⓪① 聲音", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: (r.clean, r.drop_reason, r.hits, r.stripped) for r in cl.clean_segments(df).collect()}
    assert got[0] == ("應該 好的啊", None, 1, False)
    assert got[1][1] == "hallucination"
    assert got[2][1] == "empty" and got[2][3]
    assert got[3] == ("今天天氣很好", None, 0, True)
    assert got[4][1] == "empty"
    assert got[5][1] == "garbled"
    assert got[6][1] == "garbled"
    assert got[7][1] == "empty"
    stats = cl.clean_stats(cl.clean_segments(df).withColumn("session_id", F.lit(0))).first()
    assert stats.original == len(texts) == (
        stats.dropped_empty + stats.dropped_hallucination + stats.dropped_garbled + stats.surviving
    )


def test_repeat_loops(spark):
    texts = ["嘗嘗嘗嘗好", "反而反而反而", "正常的一句話", "開頭沒事然後一起一起一起一起走", "a�b", "我是King。", "xyxyxyx開"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    reasons = [r.asr_artifact_reason for r in cl.flag_artifacts(df).collect()]
    assert [bool(r) for r in reasons] == [True, True, False, True, True, False, False]
    assert reasons[0] == "同字元連續重複 4 次"
    assert reasons[1] == "整句僅由 2 種字元組成(6 字)"
    assert reasons[3] == "短語「一起」連續重複 4 次"


def brute_loop(text):
    """Every alignment rule spelled out over the whole text."""
    for n in range(2, 7):
        i = 0
        while i + n <= len(text):
            gram = text[i : i + n]
            times, j = 1, i + n
            while text[j : j + n] == gram:
                times, j = times + 1, j + n
            if gram.strip() and times >= 4:
                return (gram, times)
            i = j if times > 1 and gram.strip() else i + 1
    return None


def test_repeat_loop_scan_matches_brute_force(spark):
    import random

    rng = random.Random(5)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randrange(12, 60))).strip() for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts if t], "text string")
    for r in cl.flag_artifacts(df).collect():
        if r.asr_artifact_reason.startswith("短語"):
            gram, times = brute_loop(r.text)
            assert r.asr_artifact_reason == f"短語「{gram}」連續重複 {times} 次"
        elif not r.asr_artifact:
            assert brute_loop(r.text) is None


@pytest.mark.parametrize(
    "line,wanted,changes",
    [
        ("你好,世界.", "你好，世界。", 2),
        ("plain, text.", "plain, text.", 0),
        ("價格 1,000.50 元;", "價格 1,000.50 元；", 1),
        ("見 https://a.b/c 與 9:30...", "見 https://a.b/c 與 9:30……", 1),
        ("看 `a,b` 和 [x,y](u,v.png)!", "看 `a,b` 和 [x,y](u,v.png)！", 1),
        ("好,)(", "好，）（", 3),
        ("甲:乙 a.b", "甲：乙 a.b", 1),
    ],
)
def test_width(spark, line, wanted, changes):
    out = apply(spark, [line], tx.normalize_width_line)[0]
    assert (out.line, out.changes) == (wanted, changes)
    again = apply(spark, [wanted], tx.normalize_width_line)[0]
    assert again.changes == 0


def test_fences_are_left_alone(spark, rows):
    lines = ["好,", "```", "好,", "```", "好,"]
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(lines)], "doc_id int, line_no int, line string")
    out = cl.normalize_width(df, rows=2)
    assert rows(out, "line_no", "line") == [(0, "好，"), (1, "```"), (2, "好,"), (3, "```"), (4, "好，")]
    assert rows(cl.residual_halfwidth(df)) == [(0, 2)]


def test_strikes(spark):
    out = apply(spark, ["a ~~b c~~ d", "x~~y", "~~~~", "~~a~~b~~c", "a~~ ~~b"], tx.parse_strikes)
    assert [(r.clean, [tuple(s) for s in r.spans]) for r in out] == [
        ("a b c d", [(1, 3)]),
        ("x~~y", []),
        ("", []),
        ("ab~~c", [(0, 1)]),
        ("a b", []),
    ]


def test_language_sections_terms(spark):
    assert apply(spark, ["第三章 開始", "Chapter IV: x", "section 2.1 y", "1. 步驟", "第 2 節"], tx.section_level) == [
        "chapter", "chapter", "section", None, "section",
    ]
    assert apply(spark, ["漢字 ab", "hello", "12"], tx.detect_lang) == ["zh", "en", "unknown"]
    assert sorted(apply(spark, ["天氣好 A1b x 892 天"], tx.terms)[0]) == ["892", "a1b", "天", "天氣", "氣好"]


def test_clock(spark):
    assert apply(spark, [3661005, 59999, -5], ck.ms_to_srt, "v bigint") == ["01:01:01,005", "00:00:59,999", "00:00:00,000"]
    assert apply(spark, [3661005, 59999], ck.ms_to_clock, "v bigint") == ["1:01:01", "0:59"]
    assert apply(spark, ["736.45", "12:16.45", "1:02:16.4"], ck.clock_to_ms) == [736450, 736450, 3736400]
    assert apply(spark, ["00:00:01.5", "01:00:00,25"], ck.srt_to_ms) == [1500, 3600250]


@pytest.mark.parametrize(
    "rule", [tx.is_english_hallucination, tx.is_batch_dropped, lambda c: cl.repeat_loop_reason(c).isNotNull()], ids=["en", "batch", "loop"]
)
def test_a_text_is_stripped_once_for_all_rules(spark, rule):
    found = spark.createDataFrame([("x",)], "text string").filter(rule(F.col("text")))
    assert found._jdf.queryExecution().optimizedPlan().toString().count(r"^\s+|\s+$") == 1


def test_anchored_patterns_are_joined_at_one_start():
    assert tx.any_of(["^a$", r"\bb", "^c|d", "^e"]) == r"(?U)(?:^(?:(?:a$)|(?:e))|(?:\bb)|(?:^c|d))"
