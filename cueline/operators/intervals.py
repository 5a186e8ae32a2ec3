"""Interval algebra on session timelines.

All times are BIGINT milliseconds.  Joins on time go through equal-width bins,
so they are hash joins rather than nested loops; merges and gaps are running
maxima over time chunks (see ``scan``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueline.operators.scan import (
    CHUNK_MS,
    as_list,
    nearest_value,
    running_count,
    running_max,
    running_sum,
    scan,
    time_chunk,
    with_neighbours,
)
from cueline.session import settle

#: Default bin of the time joins; about the length of a cue.
BIN_MS = 5_000
def _bins(start: Column, end: Column, width: int) -> Column:
    first = F.floor(start / F.lit(width)).cast("bigint")
    last = F.floor(F.greatest(start, end - 1) / F.lit(width)).cast("bigint")
    return F.sequence(first, last)


def spread_heavy(
    left: DataFrame, right: DataFrame, keys: Sequence[str], heavy_rows: int
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Salt the fullest join keys of either side: its rows are dealt out, the other side's repeated.

    Returns both sides with two more key columns.  Keys that are not full get the single salts 0, so no pair is
    lost or doubled.
    """
    keys = list(keys)

    def full(side: DataFrame, name: str) -> DataFrame:
        counted = side.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > heavy_rows)
        return counted.select(*keys, F.ceil(F.col("__n") / heavy_rows).cast("int").alias(name))

    heavy = full(left, "__nl").join(full(right, "__nr"), keys, "full")

    def salted(side: DataFrame, own: str, other: str, salt: str, copy: str) -> DataFrame:
        dealt = F.pmod(F.xxhash64(*side.columns), F.coalesce(F.col(own), F.lit(1)).cast("bigint")).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))
        return side.join(heavy, keys, "left").select(*side.columns, dealt.alias(salt), copies.alias(copy))

    return (
        salted(left, "__nl", "__nr", "__sl", "__sr"),
        salted(right, "__nr", "__nl", "__sr", "__sl"),
        [*keys, "__sl", "__sr"],
    )


def interval_join(
    left: DataFrame,
    right: DataFrame,
    by: str | Sequence[str] = "session_id",
    bin_ms: int = BIN_MS,
    left_span: tuple[str, str] = ("start_ms", "end_ms"),
    right_span: tuple[str, str] = ("start_ms", "end_ms"),
    heavy_rows: int | None = None,
) -> DataFrame:
    """Pairs with ``left.start < right.end`` and ``left.end > right.start``.

    Both sides are listed in every bin they touch; a pair is kept only in the
    later of the two first bins, so it appears once without a distinct.  Right
    columns come back with the prefix ``r_``.  Full bins are split by the adaptive
    join, on either side; ``heavy_rows`` salts them beforehand, at the price of counting them.
    """
    by = as_list(by)
    renamed = right.select(*by, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in by])
    ls, le = left_span
    rs, re_ = f"r_{right_span[0]}", f"r_{right_span[1]}"
    lb = left.withColumn("__bin", F.explode(_bins(F.col(ls), F.col(le), bin_ms)))
    rb = renamed.withColumn("__bin", F.explode(_bins(F.col(rs), F.col(re_), bin_ms)))
    keys = [*by, "__bin"]
    if heavy_rows is not None:
        lb, rb, keys = spread_heavy(lb, rb, keys, heavy_rows)
    home = F.floor(F.greatest(F.col(ls), F.col(rs)) / F.lit(bin_ms)).cast("bigint")
    return (
        lb.join(rb, keys)
        .filter(
            (F.col("__bin") == home) & (F.col(ls) < F.col(re_)) & (F.col(le) > F.col(rs))
        )
        .drop("__bin", "__sl", "__sr")
    )


def overlap_ms(prefix: str = "r_") -> Column:
    return F.least("end_ms", f"{prefix}end_ms") - F.greatest("start_ms", f"{prefix}start_ms")


def merge_intervals(
    df: DataFrame,
    by: str | Sequence[str] = "session_id",
    min_gap_ms: int = 200,
    inclusive: bool = False,
    pad_ms: int = 0,
    chunk_ms: int = CHUNK_MS,
) -> DataFrame:
    """Union of intervals; neighbours closer than ``min_gap_ms`` become one.

    ``inclusive`` also joins neighbours exactly ``min_gap_ms`` apart.  Empty
    intervals are dropped first.
    """
    by = as_list(by)
    spans = df.select(
        *by,
        F.greatest(F.lit(0), F.col("start_ms") - pad_ms).alias("start_ms")
        if pad_ms
        else F.col("start_ms"),
        (F.col("end_ms") + pad_ms).alias("end_ms"),
    ).filter(F.col("end_ms") > F.col("start_ms"))
    chunk = time_chunk("start_ms", chunk_ms)
    order = ["start_ms", "end_ms"]
    reached = scan(spans, by, order, chunk, reach=running_max(F.col("end_ms")))
    gap = F.col("start_ms") - F.col("reach")
    opens = F.col("reach").isNull() | ((gap > min_gap_ms) if inclusive else (gap >= min_gap_ms))
    numbered = scan(
        reached, by, order, chunk, island=running_sum(F.when(opens, 1).otherwise(0))
    )
    return (
        numbered.groupBy(*by, "island")
        .agg(
            F.min("start_ms").alias("start_ms"),
            F.max("end_ms").alias("end_ms"),
            F.count("*").alias("parts"),
        )
        .drop("island")
    )


def subtract_intervals(
    keep: DataFrame,
    drop: DataFrame,
    by: str | Sequence[str] = "session_id",
    min_frag_ms: int = 120,
    bin_ms: int = BIN_MS,
    chunk_ms: int = CHUNK_MS,
    key: Sequence[str] = ("start_ms", "end_ms"),
) -> DataFrame:
    """``keep`` minus the union of ``drop``; pieces under ``min_frag_ms`` go.

    ``key`` names the columns that identify a row of ``keep`` besides ``by``.
    Extra columns of ``keep`` are carried to every piece.
    """
    by = as_list(by)
    extra = [c for c in keep.columns if c not in (*by, "start_ms", "end_ms")]
    ident = [*by, *[c for c in key if c not in by]]
    removals = merge_intervals(drop, by, 0, chunk_ms=chunk_ms).drop("parts")
    hits = settle(interval_join(keep, removals, by, bin_ms))
    # Removals of one kept range are disjoint and ordered: each one closes the
    # piece that began where the previous removal ended.
    chained = with_neighbours(
        hits,
        ident,
        ["r_start_ms"],
        time_chunk("r_start_ms", chunk_ms),
        previous={"prev_end": "r_end_ms"},
    )
    inner = chained.select(
        *by,
        *extra,
        F.greatest("start_ms", F.coalesce("prev_end", "start_ms")).alias("a"),
        F.col("r_start_ms").alias("b"),
    )
    tails = hits.groupBy(*ident).agg(F.max("r_end_ms").alias("last_end"))
    tail = keep.join(tails, ident, "left").select(
        *by,
        *extra,
        F.greatest("start_ms", F.coalesce("last_end", "start_ms")).alias("a"),
        F.col("end_ms").alias("b"),
    )
    return (
        inner.unionByName(tail)
        .filter((F.col("b") > F.col("a")) & (F.col("b") - F.col("a") >= min_frag_ms))
        .withColumnsRenamed({"a": "start_ms", "b": "end_ms"})
    )


def coverage(
    spans: DataFrame,
    ranges: DataFrame,
    by: str | Sequence[str] = "session_id",
    key: Sequence[str] = ("idx",),
    bin_ms: int = BIN_MS,
) -> DataFrame:
    """Milliseconds of each span that lie inside ``ranges``."""
    ident = [*as_list(by), *key]
    inside = (
        interval_join(spans, ranges, by, bin_ms)
        .groupBy(*ident)
        .agg(F.sum(overlap_ms()).alias("covered_ms"))
    )
    return spans.join(inside, ident, "left").withColumn(
        "covered_ms", F.coalesce("covered_ms", F.lit(0).cast("bigint"))
    )


def find_gaps(
    blocks: DataFrame,
    by: str | Sequence[str] = "session_id",
    order: Sequence[str] = ("idx",),
    chunk: Column | None = None,
    min_gap_ms: int = 2000,
) -> DataFrame:
    """Space before a block, measured from the end of the *previous row*.

    The first gap of a session is measured from 0.  Gaps are numbered.
    """
    by = as_list(by)
    chunk = time_chunk("idx", 512) if chunk is None else chunk
    lagged = with_neighbours(blocks, by, order, chunk, previous={"prev_end": "end_ms"})
    gaps = lagged.select(
        *by,
        *order,
        F.coalesce("prev_end", F.lit(0).cast("bigint")).alias("gap_start_ms"),
        F.col("start_ms").alias("gap_end_ms"),
        F.col("block_id").alias("before"),
    ).filter(F.col("gap_end_ms") - F.col("gap_start_ms") >= min_gap_ms)
    numbered = scan(gaps, by, order, chunk, gap_no=running_count())
    return numbered.select(
        *by,
        F.format_string("G%04d", "gap_no").alias("gap_id"),
        F.col("gap_start_ms").alias("start_ms"),
        F.col("gap_end_ms").alias("end_ms"),
        "before",
        F.lit(False).alias("keep"),
    )


def find_pauses(
    cues: DataFrame,
    min_ms: int,
    by: str | Sequence[str] = "session_id",
    order: Sequence[str] = ("idx",),
    chunk: Column | None = None,
) -> DataFrame:
    """Silence between adjacent cues, in seconds with one decimal."""
    by = as_list(by)
    chunk = time_chunk("idx", 512) if chunk is None else chunk
    led = with_neighbours(cues, by, order, chunk, following={"next_start": "start_ms"})
    gap = F.col("next_start") - F.col("end_ms")
    return led.filter(gap >= min_ms).select(
        *by, F.col("end_ms").alias("t_ms"), F.round(gap / 1000.0, 1).alias("gap_s")
    )


def collapsible_pauses(
    blocks: DataFrame,
    by: str | Sequence[str] = "session_id",
    max_pause_ms: int = 900,
    chunk_ms: int = CHUNK_MS,
) -> DataFrame:
    """Pauses longer than ``max_pause_ms`` between kept blocks.

    Measured from the running maximum of the ends; touching pauses are merged.
    """
    by = as_list(by)
    reached = scan(
        blocks.select(*by, "start_ms", "end_ms", "block_id"),
        by,
        ["start_ms", "end_ms", "block_id"],
        time_chunk("start_ms", chunk_ms),
        reach=running_max(F.col("end_ms")),
    )
    pauses = reached.filter(F.col("start_ms") - F.col("reach") > max_pause_ms).select(
        *by, F.col("reach").alias("start_ms"), F.col("start_ms").alias("end_ms")
    )
    return merge_intervals(pauses, by, 0, inclusive=True, chunk_ms=chunk_ms).drop("parts")


def runs_of(
    frames: DataFrame,
    flag: Column,
    by: Sequence[str] = ("session_id", "track"),
    hop_ms: int = 10,
    min_ms: int = 0,
    frame: str = "f",
    chunk_frames: int = 6000,
    to_next_frame: bool = True,
) -> DataFrame:
    """Runs of consecutive frames where ``flag`` holds, as intervals.

    A run ends where the first frame after it begins; the last run of a track
    ends at its last frame when ``to_next_frame`` is false, one hop later
    otherwise.
    """
    by = as_list(by)
    if to_next_frame:
        hits = settle(frames.filter(flag).select(*by, frame), 1)
    else:
        # read for the last frames and several times for the hits
        frames = settle(frames.select(*by, frame, F.coalesce(flag, F.lit(False)).alias("__hit")), 1)
        last = frames.groupBy(*by).agg(F.max(frame).alias("__last"))
        hits = frames.filter("__hit").select(*by, frame)
    chunk = row_chunk_of(frame, chunk_frames)
    lagged = with_neighbours(hits, by, [frame], chunk, previous={"prev_f": frame})
    opens = F.col("prev_f").isNull() | (F.col(frame) - F.col("prev_f") > 1)
    numbered = scan(lagged, by, [frame], chunk, run=running_sum(F.when(opens, 1).otherwise(0)))
    spans = numbered.groupBy(*by, "run").agg(
        F.min(frame).alias("first_f"), F.max(frame).alias("last_f")
    )
    if to_next_frame:
        end = F.col("last_f") + 1
    else:
        spans = spans.join(last, by)
        end = F.least(F.col("last_f") + 1, F.col("__last"))
    return spans.select(
        *by,
        (F.col("first_f") * hop_ms).cast("bigint").alias("start_ms"),
        (end * hop_ms).cast("bigint").alias("end_ms"),
    ).filter(F.col("end_ms") - F.col("start_ms") >= min_ms)


def row_chunk_of(column: str, rows: int) -> Column:
    return F.floor(F.col(column) / F.lit(rows)).cast("bigint")


def close_and_filter_runs(
    runs: DataFrame,
    by: Sequence[str] = ("session_id", "track"),
    gap_ms: int = 80,
    min_ms: int = 120,
    chunk_ms: int = CHUNK_MS,
) -> DataFrame:
    """Close holes shorter than ``gap_ms``, then drop runs under ``min_ms``."""
    merged = merge_intervals(runs, by, gap_ms, chunk_ms=chunk_ms)
    return merged.filter(F.col("end_ms") - F.col("start_ms") >= min_ms).drop("parts")


def asof_remap(
    points: DataFrame,
    cut_map: DataFrame,
    by: str | Sequence[str] = "session_id",
    tempo: float = 1.0,
    chunk_ms: int = CHUNK_MS,
    key: Sequence[str] = ("idx",),
) -> DataFrame:
    """Source time to output time through the kept ranges of a cut.

    A point inside a removed range goes to the start of the next kept range; a
    point after the last one has no output time.
    """
    by = as_list(by)
    ranges = cut_map.select(
        *by,
        F.col("src_start_ms").alias("t_ms"),
        F.lit(0).alias("__kind"),
        *[F.lit(None).cast(dict(points.dtypes)[k]).alias(k) for k in key],
        F.struct("src_start_ms", "src_end_ms", "dst_start_ms").alias("__range"),
    )
    asked = points.select(
        *by,
        "t_ms",
        F.lit(1).alias("__kind"),
        *key,
        F.lit(None).cast(ranges.schema["__range"].dataType).alias("__range"),
    )
    seen = scan(
        ranges.unionByName(asked),
        by,
        ["t_ms", "__kind", *key],
        time_chunk("t_ms", chunk_ms),
        at=nearest_value(F.col("__range")),
        after=nearest_value(F.col("__range"), reverse=True),
    ).filter(F.col("__kind") == 1)
    inside = F.col("t_ms") < F.col("at.src_end_ms")
    moved = F.col("at.dst_start_ms") + (F.col("t_ms") - F.col("at.src_start_ms")) / F.lit(tempo)
    return seen.select(
        *by,
        *key,
        "t_ms",
        F.when(inside, moved).otherwise(F.col("after.dst_start_ms").cast("double")).alias("dst_ms"),
    )


def tolerant_remap(
    points: DataFrame,
    cut_map: DataFrame,
    by: str | Sequence[str] = "session_id",
    tempo: float = 1.0,
    slack_ms: int = 500,
    key: Sequence[str] = ("idx",),
    bin_ms: int = BIN_MS,
) -> DataFrame:
    """Latest output time among ranges within ``slack_ms`` of the point."""
    by = as_list(by)
    wide = cut_map.select(
        *by,
        (F.col("src_start_ms") - slack_ms).alias("start_ms"),
        (F.col("src_end_ms") + slack_ms + 1).alias("end_ms"),
        "src_start_ms",
        "dst_start_ms",
    )
    asked = points.select(
        *by, *key, F.col("t_ms").alias("start_ms"), (F.col("t_ms") + 1).alias("end_ms")
    )
    moved = F.col("r_dst_start_ms") + (F.col("start_ms") - F.col("r_src_start_ms")) / F.lit(tempo)
    found = (
        interval_join(asked, wide, by, bin_ms)
        .groupBy(*by, *key)
        .agg(F.max(moved).alias("dst_ms"))
    )
    return points.join(found, [*by, *key], "left").select(*by, *key, "t_ms", "dst_ms")


def clamp_to_words(
    silences: DataFrame,
    words: DataFrame,
    by: str | Sequence[str] = "session_id",
    pad_ms: int = 50,
    bin_ms: int = BIN_MS,
) -> DataFrame:
    """Shrink each silence to its word-free part; discard it when a word is inside.

    The narrowing is sequential over the words in time order, because later
    words are tested against bounds already moved.  The words of one silence
    are folded with an array expression; a silence bounds how many there are.
    """
    by = as_list(by)
    near = interval_join(silences, words.select(*by, "start_ms", "end_ms"), by, bin_ms)
    touched = near.groupBy(*by, "start_ms", "end_ms").agg(
        F.sort_array(
            F.collect_list(F.struct(F.col("r_start_ms").alias("a"), F.col("r_end_ms").alias("b")))
        ).alias("__words")
    )
    state = F.struct(
        F.col("start_ms").alias("lo"), F.col("end_ms").alias("hi"), F.lit(True).alias("ok")
    )

    def narrow(acc: Column, word: Column) -> Column:
        lo, hi, ok = acc["lo"], acc["hi"], acc["ok"]
        apart = ~ok | (word["b"] <= lo) | (word["a"] >= hi)
        head = word["a"] <= lo
        tail = word["b"] >= hi
        return F.struct(
            F.when(apart | ~head, lo).otherwise(F.greatest(lo, word["b"] + pad_ms)).alias("lo"),
            F.when(apart | head | ~tail, hi)
            .otherwise(F.least(hi, word["a"] - pad_ms))
            .alias("hi"),
            (ok & (apart | head | tail)).alias("ok"),
        )

    clamped = touched.withColumn("__c", F.aggregate("__words", state, narrow))
    out = silences.join(
        clamped.select(*by, "start_ms", "end_ms", "__c"), [*by, "start_ms", "end_ms"], "left"
    )
    lo = F.coalesce(F.col("__c.lo"), F.col("start_ms"))
    hi = F.coalesce(F.col("__c.hi"), F.col("end_ms"))
    usable = F.coalesce(F.col("__c.ok"), F.lit(True)) & (hi > lo)
    return out.select(
        *silences.columns,
        F.when(usable, lo).alias("lo_ms"),
        F.when(usable, hi).alias("hi_ms"),
    )


def tighten_pauses(
    ranges: DataFrame,
    silences: DataFrame,
    words: DataFrame,
    by: str | Sequence[str] = "session_id",
    max_pause_ms: int = 900,
    keep_ms: int = 600,
    margin_ms: int = 300,
    bin_ms: int = BIN_MS,
) -> DataFrame:
    """Removals that shorten long silences inside kept ranges to ``keep_ms``."""
    by = as_list(by)
    clamped = clamp_to_words(silences, words, by, bin_ms=bin_ms).filter(
        F.col("hi_ms") - F.col("lo_ms") > max_pause_ms
    )
    pairs = interval_join(ranges, clamped, by, bin_ms)
    inside = (F.col("r_start_ms") > F.col("start_ms") + margin_ms) & (
        F.col("r_end_ms") < F.col("end_ms") - margin_ms
    )
    half = keep_ms // 2
    return pairs.filter(inside).select(
        *by,
        (F.col("r_lo_ms") + half).alias("start_ms"),
        (F.col("r_hi_ms") - half).alias("end_ms"),
    )


def _boundaries(ranges: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    return ranges.select(
        *by,
        *key,
        F.explode(
            F.array(
                F.struct(F.col("start_ms").alias("t_ms"), F.lit(True).alias("is_start")),
                F.struct(F.col("end_ms").alias("t_ms"), F.lit(False).alias("is_start")),
            )
        ).alias("__b"),
    ).select(*by, *key, "__b.*")


def _rejoin(moved: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    return moved.groupBy(*by, *key).agg(
        F.max(F.when(F.col("is_start"), F.col("new_ms"))).alias("start_ms"),
        F.max(F.when(~F.col("is_start"), F.col("new_ms"))).alias("end_ms"),
    )


def snap_boundaries(
    ranges: DataFrame,
    silences: DataFrame,
    words: DataFrame,
    by: str | Sequence[str] = "session_id",
    key: Sequence[str] = ("idx",),
    window_ms: int = 400,
    long_ms: int = 1000,
    pad_ms: int = 120,
    bin_ms: int = BIN_MS,
) -> DataFrame:
    """Move range edges into nearby silences.

    A short silence pulls the edge to its middle; a long one to its near end,
    leaving ``pad_ms``.  A long silence that a word runs through holds the edge.
    The first silence in time order that reaches the edge decides.
    """
    by, key = as_list(by), list(key)
    clamped = clamp_to_words(silences, words, by, bin_ms=bin_ms).select(
        *by,
        (F.col("start_ms") - window_ms).alias("start_ms"),
        (F.col("end_ms") + window_ms + 1).alias("end_ms"),
        F.col("start_ms").alias("a"),
        F.col("end_ms").alias("b"),
        "lo_ms",
        "hi_ms",
    )
    edges = _boundaries(ranges, by, key)
    points = edges.select(
        *by,
        *key,
        "is_start",
        F.col("t_ms").alias("start_ms"),
        (F.col("t_ms") + 1).alias("end_ms"),
    )
    first = (
        interval_join(points, clamped, by, bin_ms)
        .groupBy(*by, *key, "is_start")
        .agg(F.min(F.struct("r_a", "r_b", "r_lo_ms", "r_hi_ms")).alias("s"))
    )
    long = F.col("s.r_b") - F.col("s.r_a") > long_ms
    still_long = F.col("s.r_hi_ms") - F.col("s.r_lo_ms") > long_ms
    near_end = F.when(F.col("is_start"), F.col("s.r_hi_ms") - pad_ms).otherwise(
        F.col("s.r_lo_ms") + pad_ms
    )
    middle = (F.col("s.r_a") + F.col("s.r_b")) / 2.0
    moved = edges.join(first, [*by, *key, "is_start"], "left").withColumn(
        "new_ms",
        F.when(F.col("s").isNull(), F.col("t_ms").cast("double"))
        .when(long & F.col("s.r_lo_ms").isNull(), F.col("t_ms").cast("double"))
        .when(long & still_long, near_end.cast("double"))
        .otherwise(middle),
    )
    return _rejoin(moved, by, key)


def word_guard(
    ranges: DataFrame,
    words: DataFrame,
    by: str | Sequence[str] = "session_id",
    key: Sequence[str] = ("idx",),
    margin_ms: int = 30,
    push_ms: int = 20,
    bin_ms: int = BIN_MS,
) -> DataFrame:
    """Push range edges that fall strictly inside a word just outside of it."""
    by, key = as_list(by), list(key)
    edges = _boundaries(ranges.filter(F.col("end_ms") > F.col("start_ms")), by, key)
    points = edges.select(
        *by, *key, "is_start", F.col("t_ms").alias("start_ms"), F.col("t_ms").alias("end_ms")
    )
    bodies = words.select(
        *by,
        (F.col("start_ms") + margin_ms).alias("start_ms"),
        (F.col("end_ms") - margin_ms).alias("end_ms"),
    ).filter(F.col("end_ms") > F.col("start_ms"))
    first = (
        interval_join(points, bodies, by, bin_ms)
        .groupBy(*by, *key, "is_start")
        .agg(F.min(F.struct("r_start_ms", "r_end_ms")).alias("w"))
    )
    moved = edges.join(first, [*by, *key, "is_start"], "left").withColumn(
        "new_ms",
        F.when(F.col("w").isNull(), F.col("t_ms"))
        .when(F.col("is_start"), F.col("w.r_start_ms") - margin_ms - push_ms)
        .otherwise(F.col("w.r_end_ms") + margin_ms + push_ms),
    )
    return _rejoin(moved, by, key)


def cluster_1d(
    df: DataFrame,
    column: str,
    eps: float,
    by: str | Sequence[str],
    band: Column,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Number the clusters of sorted values split where the step exceeds ``eps``.

    ``band`` is a non-decreasing integer function of the value (the chunk).
    """
    by = as_list(by)
    order = [column, *tie]
    lagged = with_neighbours(df, by, order, band, previous={"__prev": column})
    opens = F.col("__prev").isNull() | (F.col(column) - F.col("__prev") > F.lit(eps))
    return scan(
        lagged, by, order, band, cluster=running_sum(F.when(opens, 1).otherwise(0))
    ).drop("__prev")


def dedupe_consecutive(
    df: DataFrame,
    column: str,
    by: str | Sequence[str],
    order: Sequence[str],
    chunk: Column,
) -> DataFrame:
    """Drop rows whose value equals that of the row just before."""
    lagged = with_neighbours(df, by, order, chunk, previous={"__prev": column})
    changed = F.col("__prev").isNull() | (F.col("__prev") != F.col(column))
    return lagged.filter(changed).drop("__prev")


def classify_gaps(
    gaps: DataFrame,
    frames: DataFrame,
    by: str | Sequence[str] = "session_id",
    hop_ms: int = 30,
    burst_db: float = -40.0,
    min_burst_ms: int = 120,
    merge_gap_ms: int = 350,
    pad_ms: int = 150,
    bin_ms: int = BIN_MS,
    chunk_ms: int = CHUNK_MS,
) -> DataFrame:
    """Split each gap into its sounding bursts, or mark it silent.

    ``frames`` has ``start_ms`` and ``level_db`` per level window of ``hop_ms``.
    """
    by = as_list(by)
    ident = [*by, "gap_id"]
    spans = frames.select(
        *by,
        "start_ms",
        (F.col("start_ms") + hop_ms).alias("end_ms"),
        "level_db",
    )
    # read for the bursts, their peaks and the level of a gap
    gaps = settle(gaps)
    inside = settle(interval_join(gaps, spans, by, bin_ms).filter(
        (F.col("r_start_ms") >= F.col("start_ms")) & (F.col("r_end_ms") <= F.col("end_ms"))
    ))
    loud = inside.filter(F.col("r_level_db") > burst_db).select(
        *ident,
        F.col("r_start_ms").alias("start_ms"),
        F.col("r_end_ms").alias("end_ms"),
        F.col("r_level_db").alias("level_db"),
    )
    bursts = merge_intervals(loud, ident, merge_gap_ms, chunk_ms=chunk_ms).filter(
        F.col("end_ms") - F.col("start_ms") >= min_burst_ms
    )
    peaks = (
        interval_join(bursts, loud, ident, bin_ms)
        .groupBy(*ident, "start_ms", "end_ms")
        .agg(F.max("r_level_db").alias("peak_db"))
    )
    top = inside.groupBy(*ident).agg(F.max("r_level_db").alias("top_db"))
    sound = peaks.withColumnsRenamed({"start_ms": "b_start", "end_ms": "b_end"})
    rows = (
        gaps.join(sound, ident, "left")
        .join(top, ident, "left")
        .select(
            *by,
            "gap_id",
            "before",
            F.when(F.col("b_start").isNull(), F.col("start_ms"))
            .otherwise(F.greatest("start_ms", F.col("b_start") - pad_ms))
            .alias("start_ms"),
            F.when(F.col("b_start").isNull(), F.col("end_ms"))
            .otherwise(F.least("end_ms", F.col("b_end") + pad_ms))
            .alias("end_ms"),
            F.when(F.col("b_start").isNull(), "silence").otherwise("sound").alias("kind"),
            F.round(F.coalesce("peak_db", "top_db"), 1).alias("peak_db"),
        )
    )
    numbered = scan(
        rows, by, ["start_ms", "end_ms", "gap_id"], time_chunk("start_ms", chunk_ms), no=running_count()
    )
    return numbered.withColumn("gap_id", F.format_string("G%04d", "no")).drop("no")
