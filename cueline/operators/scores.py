"""Per-speaker statistics, highlights, budgets and rankings."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueline.functions import constants as k
from cueline.functions import text as tx
from cueline.operators.intervals import interval_join
from cueline.operators.scan import as_list, exact_percentile, running_count, scan, time_chunk
from cueline.session import settle


def segment_features(
    cues: DataFrame,
    frames: DataFrame,
    by: str | Sequence[str] = "session_id",
    key: Sequence[str] = ("idx",),
    hop_ms: int = 10,
    char_class: str = k.IDEOGRAPH_CLASS,
    bin_frames: int = 512,
) -> DataFrame:
    """Level, pitch and rate of each cue from its frames.

    ``frames`` has ``f`` (0-based), ``level_db``, ``f0`` (null when unvoiced)
    and ``voiced``.  A cue spans at least one frame.
    """
    by, key = as_list(by), list(key)
    first = F.floor(F.col("start_ms") / hop_ms).cast("bigint")
    last = F.greatest(first + 1, F.floor(F.col("end_ms") / hop_ms).cast("bigint"))
    spans = cues.select(*by, *key, first.alias("f_a"), last.alias("f_b"))
    cells = frames.withColumn("f_end", F.col("f") + 1)
    pitch = F.when(F.col("r_voiced"), F.col("r_f0"))
    measured = (
        interval_join(spans, cells, by, bin_frames, ("f_a", "f_b"), ("f", "f_end"))
        .groupBy(*by, *key)
        .agg(
            F.percentile("r_level_db", F.lit(0.75)).alias("rms_db"),
            F.percentile(pitch, F.lit(0.75)).alias("f0_p75"),
            F.when(
                F.count(pitch) >= 4,
                F.percentile(pitch, F.lit(0.9)) - F.percentile(pitch, F.lit(0.1)),
            ).alias("f0_range"),
            F.avg(F.col("r_voiced").cast("double")).alias("voiced_ratio"),
        )
    )
    seconds = F.greatest(F.lit(0.2), (F.col("end_ms") - F.col("start_ms")) / 1000.0)
    return cues.join(measured, [*by, *key], "left").select(
        *cues.columns,
        F.coalesce("rms_db", F.lit(-80.0)).alias("rms_db"),
        "f0_p75",
        "f0_range",
        (tx.count_class(F.col("text"), char_class) / seconds).alias("rate"),
        F.coalesce("voiced_ratio", F.lit(0.0)).alias("voiced_ratio"),
    )


def excitement(
    df: DataFrame,
    by: str | Sequence[str] = "session_id",
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """Weighted per-speaker z-scores as a 0-100 score; adds ``z_*``, ``combined_z``.

    Population deviation, 0 taken as 1; a missing value scores z = 0.  Means and
    deviations are aggregated and joined back, not computed over a window.
    """
    by = as_list(by)
    weights = weights or k.EXCITEMENT_WEIGHTS
    keyed = settle(df.withColumn("__who", F.coalesce("speaker", F.lit("*"))))
    stats = keyed.groupBy(*by, "__who").agg(
        *[F.avg(F.nanvl(c, F.lit(None))).alias(f"__m_{c}") for c in weights],
        *[F.stddev_pop(F.nanvl(c, F.lit(None))).alias(f"__s_{c}") for c in weights],
    )
    joined = keyed.join(stats, [*by, "__who"])

    def z(c: str) -> Column:
        # rounding noise of equal values counts as no deviation
        spread = F.when(F.col(f"__s_{c}") < 1e-9, 1.0).otherwise(F.col(f"__s_{c}"))
        value = (F.nanvl(F.col(c), F.lit(None)) - F.col(f"__m_{c}")) / spread
        clipped = F.greatest(F.lit(-3.0), F.least(F.lit(3.0), value))
        return F.bround(F.when(value.isNull(), 0.0).otherwise(clipped), 3)

    scored = joined.select(*df.columns, *[z(c).alias(f"z_{c}") for c in weights])
    # in decimals, so that halves are halves and not left to rounding noise
    total = sum((F.col(f"z_{c}").cast("decimal(6,3)") * F.lit(Decimal(str(w))) for c, w in weights.items()), F.lit(Decimal(0)))
    clipped = F.greatest(F.lit(Decimal(0)), F.least(F.lit(Decimal(100)), 50 + 18 * F.col("__t")))
    return (
        scored.withColumn("__t", total)
        .withColumn("combined_z", F.bround("__t", 3).cast("double"))
        .withColumn("excitement", F.bround(clipped, 1).cast("double"))
        .drop("__t")
    )


def rank_within(
    df: DataFrame,
    by: str | Sequence[str],
    order: Sequence[str],
    band: Column,
    name: str = "rank",
) -> DataFrame:
    """Row number along ``order``; ``band`` is non-decreasing along it."""
    return scan(df, by, order, band, **{name: running_count()})


def highlights(
    scored: DataFrame,
    by: str | Sequence[str] = "session_id",
    tie: Sequence[str] = ("idx",),
    pct: float = 10.0,
    min_score: float = 60.0,
    least: int = 3,
) -> DataFrame:
    """The top percent of a session's rows by score, of those at least ``min_score``."""
    by = as_list(by)
    rows = settle(scored.withColumn("__less", -F.col("excitement")))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("__n"))
    take = F.greatest(F.lit(least), F.bround(F.col("__n") * pct / 100.0))
    ranked = rank_within(rows, by, ["__less", *tie], F.floor("__less").cast("bigint"), "__rank")
    return (
        ranked.join(sizes, by)
        .filter((F.col("__rank") <= take) & (F.col("excitement") >= min_score))
        .drop("__less", "__rank", "__n")
    )


def visible_budget(
    events: DataFrame,
    sessions: DataFrame,
    by: str | Sequence[str] = "session_id",
    tie: Sequence[str] = ("event_id",),
    per_min: float = 2.0,
    high_db: float = 6.0,
) -> DataFrame:
    """Marks at most ``floor(minutes * per_min)`` confident events as visible.

    ``sessions`` gives ``duration_ms``; every other event stays folded.
    """
    by = as_list(by)
    high = events.filter(F.col("score") >= high_db).withColumn("__less", -F.col("score"))
    ranked = rank_within(high, by, ["__less", *tie], F.floor("__less").cast("bigint"), "__rank")
    budget = F.floor(F.col("duration_ms") / 60000.0 * per_min)
    shown = (
        ranked.join(sessions, by)
        .filter(F.col("__rank") <= budget)
        .select(*by, *tie, F.lit(True).alias("visible"))
    )
    return events.join(shown, [*by, *tie], "left").withColumn(
        "visible", F.coalesce("visible", F.lit(False))
    )


def window_stats(
    frames: DataFrame,
    by: str | Sequence[str] = "session_id",
    frames_per_window: int = 120,
) -> DataFrame:
    """Energy and flatness of consecutive level windows (bounded groups)."""
    by = as_list(by)
    return (
        frames.withColumn("w", F.floor((F.col("f") - 1) / frames_per_window).cast("bigint"))
        .groupBy(*by, "w")
        .agg(
            F.avg(F.pow(F.lit(10.0), F.col("level_db") / 10.0)).alias("energy"),
            (F.max("level_db") - F.percentile("level_db", F.lit(0.1))).alias("spread_db"),
        )
    )


def quiet_and_flat(
    windows: DataFrame,
    by: str | Sequence[str] = "session_id",
    want: int = 8,
    max_spread_db: float = 12.0,
) -> DataFrame:
    """The quietest windows that are also flat.

    The quietest ``max(4 * want, ceil(n / 10))`` are the pool; of its flat
    windows the first ``want`` are taken.
    """
    by = as_list(by)
    level = F.floor(10.0 * F.log10(F.greatest(F.col("energy"), F.lit(1e-20)))).cast("bigint")
    rows = settle(windows.withColumn("__band", level))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("__n"))
    ranked = rank_within(rows, by, ["energy", "w"], F.col("__band"), "__rank")
    pool = ranked.join(sizes, by).filter(
        (F.col("__rank") <= F.greatest(F.lit(4 * want), F.ceil(F.col("__n") * 0.1)))
        & (F.col("spread_db") <= max_spread_db)
    )
    picked = rank_within(pool, by, ["energy", "w"], F.col("__band"), "place")
    return picked.filter(F.col("place") <= want).select(*by, "w", "energy", "spread_db", "place")


def long_blocks(
    blocks: DataFrame,
    by: str | Sequence[str] = "session_id",
    tie: Sequence[str] = ("idx",),
    max_ms: int = 8000,
    worst: int = 5,
) -> DataFrame:
    """The longest blocks over ``max_ms`` of each session."""
    length = F.col("end_ms") - F.col("start_ms")
    rows = blocks.withColumn("length_ms", length).filter(F.col("length_ms") > max_ms)
    ranked = rank_within(
        rows.withColumn("__less", -F.col("length_ms")),
        by,
        ["__less", *tie],
        time_chunk("__less", 500),
        "place",
    )
    return ranked.filter(F.col("place") <= worst).drop("__less")


def retention_ratio(
    metrics: DataFrame,
    before: str,
    after: str,
    by: str | Sequence[str] = "doc_id",
    value: str = "no_space",
    lo: float = 0.95,
    hi: float = 1.05,
    warn: float = 0.85,
) -> DataFrame:
    """Share of text kept between two stages of a long metrics table."""
    by = as_list(by)

    def at(stage: str) -> Column:
        return F.max(F.when(F.col("stage") == stage, F.col(value)))

    wide = metrics.groupBy(*by).agg(at(before).alias("before"), at(after).alias("after"))
    ratio = F.col("after") / F.greatest(F.col("before"), F.lit(1))
    return wide.select(
        *by,
        F.round(ratio, 6).alias("ratio"),
        ratio.between(lo, hi).alias("in_band"),
        (ratio < warn).alias("too_low"),
    )


def latest_version(
    versions: DataFrame, by: str | Sequence[str] = "session_id", tie: str = "mtime"
) -> DataFrame:
    """Newest version per session over all stores, and the number to use next."""
    by = as_list(by)
    return (
        versions.groupBy(*by)
        .agg(F.max(F.struct("version", tie, "name")).alias("m"))
        .select(
            *by,
            F.col("m.version").alias("version"),
            F.col("m.name").alias("name"),
            (F.col("m.version") + 1).alias("next_version"),
        )
    )


def cfar_threshold(
    df: DataFrame,
    column: str,
    by: Sequence[str] = ("session_id", "track"),
    pct: float = 99.5,
    default: float | None = None,
    groups: DataFrame | None = None,
    name: str = "threshold",
) -> DataFrame:
    """Percentile of the negative samples; ``default`` for groups without any."""
    by = as_list(by)
    out = exact_percentile(df, by, column, pct, F.floor(column).cast("bigint"), name).drop("n")
    if groups is None:
        return out
    filled = groups.select(*by).distinct().join(out, by, "left")
    return filled.withColumn(name, F.coalesce(name, F.lit(default).cast("double")))
