"""Level frames of several tracks: smoothing, dominance, crosstalk, events.

``frames`` is a long table ``(session_id, track, f, level_db)`` with one row per
frame and track; ``f`` is dense within a track.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.functions import constants as k
from cueline.functions.levels import to_db, to_power
from cueline.operators.intervals import close_and_filter_runs, interval_join, row_chunk_of, runs_of
from cueline.operators.scan import as_list, exact_percentile, values_at_ranks
from cueline.session import settle

CHUNK_FRAMES = 6000


def moving_average(
    frames: DataFrame,
    win: int,
    by: Sequence[str] = ("session_id", "track"),
    value: str = "level_db",
    name: str = "smooth_db",
    chunk_frames: int = CHUNK_FRAMES,
) -> DataFrame:
    """Centred mean power over ``win`` frames, in dB; edges use what is there.

    Frames near the edge of a chunk are also copied into the neighbouring chunk,
    so each chunk can be averaged on its own with a single shuffle.
    """
    by = as_list(by)
    before = win // 2
    after = win - before - 1
    first = F.floor((F.col("f") - after) / chunk_frames).cast("bigint")
    last = F.floor((F.col("f") + before) / chunk_frames).cast("bigint")
    spread = frames.withColumn("__chunk", F.explode(F.sequence(first, last)))
    window = Window.partitionBy(*by, "__chunk").orderBy("f").rowsBetween(-before, after)
    averaged = spread.withColumn(name, to_db(F.avg(to_power(F.col(value))).over(window)))
    home = F.floor(F.col("f") / chunk_frames).cast("bigint")
    return averaged.filter(F.col("__chunk") == home).drop("__chunk")


def levels_by_frame(
    frames: DataFrame,
    by: str | Sequence[str] = "session_id",
    value: str = "level_db",
    chunk_frames: int = CHUNK_FRAMES,
) -> DataFrame:
    """One row per frame with its tracks, loudest first (a handful of tracks).

    The operators that read whole frames take this table as ``levels`` where several of them work on it.  Rows of a
    session lie together, so that what is counted by session is counted before a shuffle.
    """
    by = as_list(by)
    home = [*by, "__chunk"]
    dealt = frames.select(
        *by,
        row_chunk_of("f", chunk_frames).alias("__chunk"),
        "f",
        F.struct("track", F.col(value).alias("level_db")).alias("level"),
    ).repartition(*home)
    # one sort brings the tracks of a frame together and in order; a collecting aggregate would sort before and after the shuffle
    loudest = Window.partitionBy(*home, "f").orderBy(-F.col("level.level_db"), "level.track")
    whole = loudest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        dealt.select(
            *by, "f", F.collect_list("level").over(whole).alias("levels"), F.row_number().over(loudest).alias("__no")
        )
        .filter("__no = 1")
        .drop("__no")
    )


def lead_over_second(
    frames: DataFrame, by: str | Sequence[str] = "session_id", value: str = "level_db"
) -> DataFrame:
    """Loudest track of each frame and its margin over the runner-up."""
    by = as_list(by)
    top, second = F.get("levels", 0), F.get("levels", 1)
    return levels_by_frame(frames, by, value).select(
        *by,
        "f",
        top["track"].alias("track"),
        top["level_db"].alias("level_db"),
        second["track"].alias("second"),
        (top["level_db"] - second["level_db"]).alias("lead_db"),
    )


def calibrate_crosstalk(
    frames: DataFrame,
    by: str | Sequence[str] = "session_id",
    dominance_db: float = 12.0,
    pct: float = 30.0,
    min_samples: int = 20,
    active_db: float = -60.0,
    value: str = "level_db",
    levels: DataFrame | None = None,
) -> DataFrame:
    """How much of each talking track reaches every other one, in dB.

    Frames dominated by one track give level differences; the sample at index
    ``floor(n * pct / 100)`` counts, not an interpolated percentile.
    """
    by = as_list(by)
    levels = settle(levels_by_frame(frames, by, value), 1) if levels is None else levels
    top, second = F.get("levels", 0), F.get("levels", 1)
    ruled = levels.filter(
        (top["level_db"] > active_db) & (top["level_db"] - second["level_db"] >= dominance_db)
    )
    others = F.explode(F.slice("levels", 2, 2**31 - 1))
    samples = ruled.select(*by, top.alias("top"), others.alias("o")).select(
        *by,
        F.col("o.track").alias("track"),
        F.col("top.track").alias("source"),
        (F.col("o.level_db") - F.col("top.level_db")).alias("diff_db"),
    )
    pair = [*by, "track", "source"]
    rank = F.floor(F.col("n") * F.lit(pct / 100.0))
    picked = values_at_ranks(
        samples, pair, "diff_db", {"gain_db": rank}, F.floor("diff_db").cast("bigint")
    )
    tracks = levels.select(*by, F.explode("levels.track").alias("track")).distinct()
    tracks = tracks.groupBy(*by).agg(F.collect_list("track").alias("all"))
    pairs = (
        tracks.withColumn("track", F.explode("all")).withColumn("source", F.explode("all")).drop("all").filter("track <> source")
    )
    enough = F.when(F.col("n") >= min_samples, F.col("gain_db"))
    return pairs.join(picked, pair, "left").select(
        *pair, F.coalesce(enough, F.lit(k.CROSSTALK_FALLBACK_DB)).alias("gain_db")
    )


def predict_crosstalk(
    frames: DataFrame,
    gains: DataFrame,
    noise: DataFrame,
    by: str | Sequence[str] = "session_id",
    value: str = "level_db",
    levels: DataFrame | None = None,
) -> DataFrame:
    """Level each track would show from the other tracks and its own noise alone.

    ``gains(track, source, gain_db)`` and ``noise(track, noise_db)`` are reduced
    to one small row per session, so frames are shuffled once.  Further columns of
    ``levels`` come with every track of the frame.
    """
    by = as_list(by)
    levels = levels_by_frame(frames, by, value) if levels is None else levels
    extra = [c for c in levels.columns if c not in (*by, "f", "levels")]
    reaching = gains.groupBy(*by, "track").agg(
        F.map_from_entries(F.collect_list(F.struct("source", to_power(F.col("gain_db"))))).alias("g")
    )
    # a session with one track has no gains; its own noise is all it shows
    per_session = (
        noise.groupBy(*by)
        .agg(F.map_from_entries(F.collect_list(F.struct("track", to_power(F.col("noise_db"))))).alias("__n"))
        .join(
            reaching.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("track", "g"))).alias("__g")),
            by,
            "left",
        )
    )
    powers = F.transform(
        "levels",
        lambda x: F.struct(x["track"].alias("track"), x["level_db"].alias("level_db"), to_power(x["level_db"]).alias("power")),
    )
    rows = levels.withColumn("levels", powers).join(per_session, by)
    one = rows.select(*by, "f", *extra, "levels", "__g", "__n", F.explode("levels").alias("t")).withColumn(
        "__g", F.element_at("__g", F.col("t.track"))
    )

    def share(level: Column) -> Column:
        return F.when(level["track"] == F.col("t.track"), 0.0).otherwise(
            level["power"] * F.element_at("__g", level["track"])
        )

    total = F.aggregate(
        "levels", F.element_at("__n", F.col("t.track")), lambda acc, x: acc + share(x)
    )
    return one.select(
        *by,
        F.col("t.track").alias("track"),
        "f",
        F.col("t.level_db").alias("level_db"),
        to_db(total).alias("predicted_db"),
        *extra,
    )


def _quiet(levels: DataFrame, by: Sequence[str], pct: float) -> DataFrame:
    topped = levels.withColumn("top_db", F.array_max("levels.level_db"))
    limit = exact_percentile(
        topped, by, "top_db", pct, F.floor("top_db").cast("bigint"), "limit_db"
    ).drop("n")
    return topped.join(limit, by).filter("top_db < limit_db")


def quiet_frames(
    frames: DataFrame, by: str | Sequence[str] = "session_id", pct: float = 20.0
) -> DataFrame:
    """Frames whose loudest track is below the session's ``pct`` percentile."""
    by = as_list(by)
    return _quiet(settle(levels_by_frame(frames, by), 1), by, pct).select(*by, "f")


def noise_floor(
    frames: DataFrame,
    by: str | Sequence[str] = "session_id",
    quiet_pct: float = 20.0,
    pct: float = 99.5,
    fallback_pct: float = 1.0,
    margin_db: float = 6.0,
    levels: DataFrame | None = None,
) -> DataFrame:
    """Noise level per track from the frames in which nobody speaks."""
    by = as_list(by)
    levels = settle(levels_by_frame(frames, by), 1) if levels is None else levels
    keys = [*by, "track"]
    band = F.floor("level_db").cast("bigint")

    def tracks_of(rows: DataFrame) -> DataFrame:
        return rows.select(*by, F.explode("levels").alias("t")).select(*by, "t.track", "t.level_db")

    still = tracks_of(_quiet(levels, by, quiet_pct))
    high = exact_percentile(still, keys, "level_db", pct, band, "q").drop("n")
    low = exact_percentile(tracks_of(levels), keys, "level_db", fallback_pct, band, "d").drop("n")
    return low.join(high, keys, "left").select(
        *keys,
        F.coalesce("q", "d").alias("noise_db"),
        (F.coalesce("q", "d") + margin_db).alias("floor_db"),
    )


def room_noise(
    frames: DataFrame,
    spans: DataFrame,
    by: str | Sequence[str] = "session_id",
    pct: float = 25.0,
    hop_ms: int = 10,
    bin_ms: int = 5000,
) -> DataFrame:
    """Level of the quiet part of the sampled spans: a percentile over their short windows.

    Tracks are added up as powers.  A session without a frame in its spans gets -90.
    """
    by = as_list(by)
    mixed = frames.groupBy(*by, "f").agg((10 * F.log10(F.sum(F.pow(F.lit(10.0), F.col("level_db") / 10)))).alias("mix_db"))
    windows = mixed.select(*by, (F.col("f") * hop_ms).alias("start_ms"), ((F.col("f") + 1) * hop_ms).alias("end_ms"), "mix_db")
    inside = interval_join(windows, spans.select(*by, "start_ms", "end_ms"), by, bin_ms).filter(
        (F.col("start_ms") >= F.col("r_start_ms")) & (F.col("end_ms") <= F.col("r_end_ms"))
    )
    level = exact_percentile(inside, by, "mix_db", pct, F.floor("mix_db").cast("bigint"), "noise_db").drop("n")
    return spans.select(*by).distinct().join(level, by, "left").withColumn("noise_db", F.coalesce("noise_db", F.lit(-90.0)))


def drop_self_adjacent(
    events: DataFrame,
    own: DataFrame,
    by: Sequence[str] = ("session_id", "track"),
    guard_ms: int = 250,
    bin_ms: int = 5000,
) -> DataFrame:
    """Events that keep at least ``guard_ms`` from the track's own speech."""
    by = as_list(by)
    wide = own.select(
        *by,
        (F.col("start_ms") - guard_ms).alias("start_ms"),
        (F.col("end_ms") + guard_ms).alias("end_ms"),
    )
    near = interval_join(events, wide, by, bin_ms).select(*events.columns).distinct()
    return events.join(near, [*by, "start_ms", "end_ms"], "left_anti")


def unclaimed_events(
    frames: DataFrame,
    own: DataFrame,
    by: Sequence[str] = ("session_id", "track"),
    pct: float = 99.5,
    default_db: float = 10.0,
    hop_ms: int = 10,
    gap_ms: int = 80,
    min_ms: int = 120,
    guard_ms: int = 250,
) -> DataFrame:
    """Sounds of a track while only others are credited with speech.

    ``frames`` has ``residual_db, level_db, floor_db`` and the flags ``own``
    (speech of this track), ``others`` and ``negative`` (dominated by another
    track).  The threshold is the percentile of the negative residuals.
    """
    by = as_list(by)
    frames = settle(frames, 1)
    negatives = frames.filter("negative AND NOT own")
    band = F.floor("residual_db").cast("bigint")
    limits = exact_percentile(negatives, by, "residual_db", pct, band, "limit_db").drop("n")
    # what the limit does not decide goes before the frames meet their limit
    likely = frames.filter((F.col("level_db") >= F.col("floor_db")) & F.col("others") & ~F.col("own"))
    judged = likely.select(*by, "f", "residual_db").join(limits, by, "left")
    runs = runs_of(judged, F.col("residual_db") >= F.coalesce("limit_db", F.lit(default_db)), by, hop_ms)
    events = close_and_filter_runs(runs, by, gap_ms, min_ms)
    return drop_self_adjacent(events, own, by, guard_ms)
