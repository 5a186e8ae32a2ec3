"""From plan rows to units, seams and positions on the output axis.

Plan rows are ordered by ``seq``, a dense row number per session.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueline.functions import text as tx
from cueline.operators.intervals import BIN_MS, interval_join
from cueline.operators.scan import (
    CHUNK_ROWS,
    as_list,
    nearest_value,
    row_chunk,
    running_max,
    running_sum,
    scan,
    with_neighbours,
)
from cueline.session import settle


def anchor_structure(
    lines: DataFrame, by: str | Sequence[str] = "session_id", time: str = "t_ms", rows: int = CHUNK_ROWS
) -> DataFrame:
    """Lines without a time take that of the next timed line (null at the end)."""
    following = nearest_value(F.col(time), inclusive=True, reverse=True)
    return scan(lines, by, ["seq"], row_chunk("seq", rows), anchor_ms=following)


def join_units(
    program: DataFrame,
    by: str | Sequence[str] = "session_id",
    max_gap_ms: int = 2000,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Consecutive kept blocks that follow each other in time become one unit.

    ``program`` has ``seq, kind, keep, clip, start_ms, end_ms``.  A unit ends
    where its last block ends, so the previous row decides.  Rows of another
    kind end a unit; rows that are not kept do not.
    """
    by = as_list(by)
    chunk = row_chunk("seq", rows)
    live = program.filter((F.col("kind") != "block") | F.col("keep"))
    lagged = with_neighbours(
        live,
        by,
        ["seq"],
        chunk,
        previous={"p_kind": "kind", "p_end": "end_ms", "p_clip": "clip"},
    ).filter("kind = 'block'")
    step = F.col("start_ms") - F.col("p_end")
    joins = (
        (F.col("p_kind") == "block")
        & (F.col("p_clip") == F.col("clip"))
        & (step >= 0)
        & (step < max_gap_ms)
    )
    opens = F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)
    numbered = scan(lagged, by, ["seq"], chunk, unit=running_sum(opens))
    return numbered.groupBy(*by, "unit").agg(
        F.min_by("start_ms", "seq").alias("start_ms"),
        F.max_by("end_ms", "seq").alias("end_ms"),
        F.first("clip").alias("clip"),
        F.min("seq").alias("first_seq"),
        F.count("*").alias("blocks"),
    )


def seam_overlap(
    segments: DataFrame,
    by: str | Sequence[str] = "session_id",
    xfade_ms: float = 40.0,
    tempo: float = 1.0,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Length on the output axis and fade into the previous segment.

    ``segments`` has ``seq, kind, start_ms, end_ms, faded`` (fades already in
    the audio).  Speech is sped up by ``tempo``.  Beside silence, inserts and
    faded edges the seam is 10 ms; it never eats more than half a segment.
    """
    by = as_list(by)
    length = F.col("end_ms") - F.col("start_ms")
    timed = segments.withColumn(
        "dur_ms", F.when(F.col("kind") == "speech", length / F.lit(tempo)).otherwise(length.cast("double"))
    )
    lagged = with_neighbours(
        timed,
        by,
        ["seq"],
        row_chunk("seq", rows),
        previous={"p_kind": "kind", "p_dur": "dur_ms", "p_faded": "faded"},
    )
    soft = F.col("kind").isin("silence", "insert") | F.col("p_kind").isin("silence", "insert")
    soft = soft | F.col("faded") | F.col("p_faded")
    cf = F.when(soft, 10.0).otherwise(xfade_ms)
    seam = F.greatest(F.lit(5.0), F.least(cf, F.col("p_dur") / 2 - 5, F.col("dur_ms") / 2 - 5))
    return lagged.withColumn(
        "seam_ms", F.when(F.col("p_kind").isNull(), 0.0).otherwise(seam)
    ).drop("p_kind", "p_dur", "p_faded")


def output_timeline(
    segments: DataFrame, by: str | Sequence[str] = "session_id", rows: int = CHUNK_ROWS, **seams
) -> DataFrame:
    """Adds ``dst_start_ms``: earlier lengths less the seams up to this segment."""
    seamed = seam_overlap(segments, by, rows=rows, **seams)
    placed = scan(
        seamed,
        by,
        ["seq"],
        row_chunk("seq", rows),
        __before=running_sum(F.col("dur_ms"), inclusive=False),
        __seams=running_sum(F.col("seam_ms")),
    )
    start = F.greatest(F.lit(0.0), F.col("__before") - F.col("__seams"))
    return placed.withColumn("dst_start_ms", start).drop("__before", "__seams")


def chapters(
    headings: DataFrame,
    timeline: DataFrame,
    by: str | Sequence[str] = "session_id",
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Output time of each heading: where the next segment starts.

    ``headings(seq, title)`` and ``timeline(seq, dst_start_ms)`` share the plan
    order; a heading after the last segment has no place and is left out.
    """
    by = as_list(by)
    marks = timeline.select(
        *by, "seq", F.lit(1).alias("k"), F.lit(None).cast("string").alias("title"), F.col("dst_start_ms").alias("d")
    ).unionByName(
        headings.select(*by, "seq", F.lit(0).alias("k"), "title", F.lit(None).cast("double").alias("d"))
    )
    found = scan(
        marks, by, ["seq", "k"], row_chunk("seq", rows), at_ms=nearest_value(F.col("d"), reverse=True)
    )
    return found.filter("k = 0 AND at_ms IS NOT NULL").select(*by, "seq", "title", "at_ms")


def overlay_gaps(
    units: DataFrame,
    by: str | Sequence[str] = "session_id",
    lead_max_ms: int = 3000,
    least_ms: int = 100,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """What becomes of each music row laid over speech.

    ``units`` has ``seq, kind`` and for music ``dur_ms, lead_ms, tail_ms``.
    Lead and tail count only beside speech.  When speech follows, the solo
    stretch between them must last at least ``least_ms``.
    """
    by = as_list(by)
    speech = F.when(F.col("kind") == "speech", F.lit(1))
    around = scan(
        units,
        by,
        ["seq"],
        row_chunk("seq", rows),
        __p=nearest_value(speech),
        __n=nearest_value(speech, reverse=True),
    ).filter("kind = 'music'")
    has_prev, has_next = F.col("__p").isNotNull(), F.col("__n").isNotNull()
    lead = F.when(has_prev, F.least("lead_ms", F.lit(lead_max_ms))).otherwise(0)
    tail = F.when(has_next, F.col("tail_ms")).otherwise(0)
    solo = F.when(has_next, F.col("dur_ms") - lead - tail)
    return around.select(
        *by,
        "seq",
        "dur_ms",
        lead.cast("bigint").alias("lead_ms"),
        tail.cast("bigint").alias("tail_ms"),
        has_prev.alias("has_prev"),
        has_next.alias("has_next"),
        solo.cast("bigint").alias("gap_ms"),
        F.coalesce(solo < least_ms, F.lit(False)).alias("is_error"),
    )


def envelope_points(
    df: DataFrame, duck: float = 0.15, solo: float = 0.55, predrop: float = 1.0, rise: float = 1.0
) -> DataFrame:
    """Volume key points of each music row: ``points`` of ``(t, v)``.

    Columns in seconds: ``dur, fadein, fadeout, lead, tail`` and the flags
    ``has_prev, has_next``.  Times never run backwards and stay within the music.
    """

    def point(t: Column, v: Column | float) -> Column:
        return F.struct(t.cast("double").alias("t"), F.lit(v).cast("double").alias("v"))

    c = F.col
    begin = F.when(
        c("has_prev"),
        F.array(
            point(F.least("fadein", F.greatest("lead", F.lit(0.1))), duck),
            point(c("lead"), duck),
            point(c("lead") + rise, solo),
        ),
    ).otherwise(F.array(point(c("fadein"), solo)))
    entry = c("dur") - c("tail")
    out = F.least("fadeout", F.greatest("tail", F.lit(0.1)))
    finish = F.when(
        c("has_next"),
        F.array(point(entry - predrop, solo), point(entry, duck), point(entry + out, 0.0)),
    ).otherwise(F.array(point(c("dur") - c("fadeout"), solo)))
    raw = F.concat(F.array(point(F.lit(0.0), 0.0)), begin, finish, F.array(point(c("dur"), 0.0)))
    none = F.array().cast("array<struct<t:double,v:double>>")

    def add(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        known = F.size(acc) > 0
        t = F.least(F.greatest(p["t"], F.when(known, last["t"]).otherwise(0.0)), c("dur"))
        same = known & (F.abs(t - last["t"]) < 1e-6) & (F.abs(p["v"] - last["v"]) < 1e-6)
        return F.when(same, acc).otherwise(
            F.concat(acc, F.array(F.struct(t.alias("t"), p["v"].alias("v"))))
        )

    return df.withColumn("points", F.aggregate(raw, none, add))


def reference_window(
    segments: DataFrame,
    by: str | Sequence[str] = "session_id",
    ms: int = 15_000,
    rows: int = CHUNK_ROWS,
    bin_ms: int = 30_000,
) -> DataFrame:
    """Speech around each insert: up to ``ms`` collected on each side.

    Speech is laid end to end on an axis of its own; an insert then looks
    ``ms`` back and ahead on that axis, and the last segment is taken in part.
    """
    by = as_list(by)
    length = F.when(F.col("kind") == "speech", F.col("end_ms") - F.col("start_ms")).otherwise(0)
    placed = settle(
        scan(segments, by, ["seq"], row_chunk("seq", rows), at=running_sum(length, inclusive=False))
    )
    speech = placed.filter("kind = 'speech'").select(
        *by,
        F.col("at").alias("x"),
        (F.col("at") + F.col("end_ms") - F.col("start_ms")).alias("y"),
        F.col("start_ms").alias("a"),
        F.col("end_ms").alias("b"),
    )
    sides = F.explode(
        F.array(
            F.struct(F.lit("before").alias("side"), (F.col("at") - ms).alias("p"), F.col("at").alias("q")),
            F.struct(F.lit("after").alias("side"), F.col("at").alias("p"), (F.col("at") + ms).alias("q")),
        )
    )
    wanted = placed.filter("kind = 'insert'").select(*by, "seq", sides.alias("s")).select(*by, "seq", "s.*")
    pairs = interval_join(wanted, speech, by, bin_ms, ("p", "q"), ("x", "y"))
    take = F.least("q", "r_y") - F.greatest("p", "r_x")
    before = F.col("side") == "before"
    return pairs.select(
        *by,
        "seq",
        "side",
        F.when(before, F.col("r_b") - take).otherwise(F.col("r_a")).alias("start_ms"),
        F.when(before, F.col("r_b")).otherwise(F.col("r_a") + take).alias("end_ms"),
    )


def _block_words(
    blocks: DataFrame, words: DataFrame, by: list[str], before_ms: int, after_ms: int, bin_ms: int
) -> DataFrame:
    """Words around each block in time order (bounded by the block's length)."""
    wide = blocks.select(
        *by,
        "block_id",
        (F.col("start_ms") - before_ms).alias("w_a"),
        (F.col("end_ms") + after_ms).alias("w_b"),
    )
    near = interval_join(
        wide, words.select(*by, "start_ms", "end_ms", "pos", "word"), by, bin_ms, ("w_a", "w_b")
    )
    entry = F.struct(
        F.col("r_start_ms").alias("a"),
        F.col("r_end_ms").alias("b"),
        F.col("r_pos").alias("pos"),
        tx.no_space(F.col("r_word")).alias("w"),
    )
    return near.groupBy(*by, "block_id").agg(F.array_sort(F.collect_list(entry)).alias("ws"))


def strikes_to_time(
    blocks: DataFrame,
    strikes: DataFrame,
    words: DataFrame,
    by: str | Sequence[str] = "session_id",
    pad_ms: int = 40,
    slack_ms: int = 300,
    bin_ms: int = BIN_MS,
) -> DataFrame:
    """Time removed by each struck span ``(a, b)`` of a block's visible text.

    The block's text is located in the characters of the words around it; where
    it is not found, time is interpolated over the block.
    """
    by = as_list(by)
    ident = [*by, "block_id"]
    near = _block_words(blocks, words, by, slack_ms, slack_ms, bin_ms)
    joined = (
        strikes.join(blocks.select(*ident, "start_ms", "end_ms", "text"), ident)
        .join(near, ident, "left")
        .withColumn("flat", tx.no_space(F.col("text")))
        .withColumn("ws", F.coalesce("ws", F.array().cast("array<struct<a:bigint,b:bigint,pos:bigint,w:string>>")))
    )
    stream = F.array_join(F.transform("ws", lambda x: x["w"]), "")
    ends = F.aggregate(
        "ws",
        F.array().cast("array<struct<upto:int,a:bigint,b:bigint>>"),
        lambda acc, x: F.concat(
            acc,
            F.array(
                F.struct(
                    (
                        F.coalesce(F.get(F.reverse(acc), 0)["upto"], F.lit(0)) + F.length(x["w"])
                    ).alias("upto"),
                    x["a"].alias("a"),
                    x["b"].alias("b"),
                )
            ),
        ),
    )
    located = joined.withColumn("at", F.instr(stream, F.col("flat")) - 1).withColumn("ends", ends)

    def word_at(place: Column) -> Column:
        return F.get(F.filter("ends", lambda e: e["upto"] > place), 0)

    exact = (F.col("at") >= 0) & (F.col("b") <= F.length("flat"))
    size = F.greatest(F.length("flat"), F.lit(1))
    dur = F.col("end_ms") - F.col("start_ms")
    t0 = F.when(exact, word_at(F.col("at") + F.col("a"))["a"].cast("double")).otherwise(
        F.col("start_ms") + dur * F.col("a") / size
    )
    t1 = F.when(exact, word_at(F.col("at") + F.col("b") - 1)["b"].cast("double")).otherwise(
        F.col("start_ms") + dur * F.col("b") / size
    )
    return located.select(
        *ident,
        "a",
        "b",
        F.greatest(F.col("start_ms").cast("double"), t0 - pad_ms).alias("cut_start_ms"),
        F.least(F.col("end_ms").cast("double"), t1 + pad_ms).alias("cut_end_ms"),
    )


def extend_edges(
    units: DataFrame,
    words: DataFrame,
    by: str | Sequence[str] = "session_id",
    key: Sequence[str] = ("unit",),
    limit_ms: int = 800,
    slack_ms: int = 300,
    bin_ms: int = BIN_MS,
) -> DataFrame:
    """Grow unit edges outward to the true edge of their first and last word.

    ``units`` carry the bounds and texts of their first and last block
    (``first_*``, ``last_*``).  The first word from the edge whose outer
    character matches the text decides, and only within ``limit_ms``.
    """
    by, key = as_list(by), list(key)
    ident = [*by, *key]

    def side(name: str) -> DataFrame:
        span = units.select(
            *ident,
            (F.col(f"{name}_start_ms") - slack_ms).alias("w_a"),
            (F.col(f"{name}_end_ms") + limit_ms).alias("w_b"),
            tx.no_space(F.col(f"{name}_text")).alias("flat"),
        ).filter("flat <> ''")
        spoken = words.select(*by, "start_ms", "end_ms", "pos", tx.no_space(F.col("word")).alias("w"))
        near = interval_join(span, spoken.filter("w <> ''"), by, bin_ms, ("w_a", "w_b"))
        order = F.struct("r_start_ms", "r_end_ms", "r_pos")
        if name == "first":
            same = F.substring("r_w", 1, 1) == F.substring("flat", 1, 1)
            hit = F.min_by("r_start_ms", order)
        else:
            same = F.substring("r_w", -1, 1) == F.substring("flat", -1, 1)
            hit = F.max_by("r_end_ms", order)
        return near.filter(same).groupBy(*ident).agg(hit.alias(f"{name}_hit"))

    joined = units.join(side("first"), ident, "left").join(side("last"), ident, "left")
    head, tail = F.col("first_hit"), F.col("last_hit")
    start_ok = (head >= F.col("first_start_ms") - limit_ms) & (head < F.col("first_start_ms"))
    end_ok = (tail > F.col("last_end_ms")) & (tail <= F.col("last_end_ms") + limit_ms)
    return joined.select(
        *ident,
        F.when(start_ok, F.least("start_ms", head)).otherwise(F.col("start_ms")).alias("start_ms"),
        F.when(end_ok, F.greatest("end_ms", tail)).otherwise(F.col("end_ms")).alias("end_ms"),
        F.coalesce(start_ok, F.lit(False)).alias("start_exact"),
        F.coalesce(end_ok, F.lit(False)).alias("end_exact"),
    )


def clamp_monotonic(
    anchors: DataFrame, by: str | Sequence[str] = "session_id", rows: int = CHUNK_ROWS
) -> DataFrame:
    """Push lines forward so that no page precedes an earlier one.

    ``anchors`` has ``deck_page, file, line``; rows without a page keep theirs.
    """
    by = as_list(by)
    paged = anchors.filter("deck_page IS NOT NULL")
    moved = scan(
        paged,
        by,
        ["deck_page", "file"],
        row_chunk("deck_page", rows),
        __m=running_max(F.col("line"), inclusive=True),
    )
    clamped = moved.withColumn("clamped", F.col("__m") > F.col("line")).withColumn("line", F.col("__m"))
    free = anchors.filter("deck_page IS NULL").withColumn("clamped", F.lit(False))
    return clamped.drop("__m").unionByName(free)
