"""Overlay of several tracks into atomic cells, and what becomes of the time.

Wide cells carry ``states``: an array of ``(track, state)`` in track order, one
entry per track of the session (a handful).  States are ``keep``, ``duck`` and
``silent``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueline.operators.intervals import (
    BIN_MS,
    merge_intervals,
    subtract_intervals,
)
from cueline.operators.scan import (
    CHUNK_MS,
    as_list,
    nearest_value,
    running_max,
    running_sum,
    scan,
    time_chunk,
    with_neighbours,
)
from cueline.session import settle

KEEP, DUCK, SILENT, CONFLICT = "keep", "duck", "silent", "conflict"


def _cells_between(edges: DataFrame, by: list[str], chunk_ms: int) -> DataFrame:
    """Spans between consecutive distinct edges ``t``."""
    led = with_neighbours(
        edges.distinct(), by, ["t"], time_chunk("t", chunk_ms), following={"b_ms": "t"}
    )
    return led.filter("b_ms IS NOT NULL").select(*by, F.col("t").alias("a_ms"), "b_ms")


def _edges(df: DataFrame, by: list[str], a: str = "start_ms", b: str = "end_ms") -> DataFrame:
    return df.select(*by, F.explode(F.array(a, b)).alias("t"))


def _openings(spans: DataFrame, keys: list[str], **kinds: Column) -> DataFrame:
    """For each edge ``a_ms``, by how many the open spans of each kind grow there."""
    ends = F.array(
        F.struct(F.col("start_ms").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_ms").alias("t"), F.lit(-1).alias("d"))
    )
    stepped = spans.filter("end_ms > start_ms").select(
        *keys, F.explode(ends).alias("__e"), *[F.coalesce(kind, F.lit(False)).alias(name) for name, kind in kinds.items()]
    )
    return stepped.groupBy(*keys, F.col("__e.t").alias("a_ms")).agg(
        *[F.sum(F.when(F.col(name), F.col("__e.d")).otherwise(0)).alias(name) for name in kinds]
    )


def _open_counts(cells: DataFrame, keys: list[str], chunk_ms: int, *openings: DataFrame) -> DataFrame:
    """``cells`` with the number of spans of each kind that are open in them: one sweep over the edges.

    Every edge of a span is the edge of a cell.  ``openings`` have all ``keys`` or the first of them.
    """
    marked, kinds = cells, []
    for stepped in openings:
        shared = [k for k in keys if k in stepped.columns]
        kinds += [c for c in stepped.columns if c not in (*keys, "a_ms")]
        marked = marked.join(stepped, [*shared, "a_ms"], "left")
    sums = {kind: running_sum(F.coalesce(F.col(kind), F.lit(0))) for kind in kinds}
    return scan(marked, keys, ["a_ms"], time_chunk("a_ms", chunk_ms), **sums)


def _leading_parts(spans: DataFrame, by: list[str], chunk_ms: int) -> DataFrame:
    """Of overlapping spans the one that begins first has the time: what it leaves of the others, as disjoint spans."""
    order = ["start_ms", "end_ms", "on"]
    reached = scan(
        spans.filter("end_ms > start_ms"), by, order, time_chunk("start_ms", chunk_ms), __reach=running_max(F.col("end_ms"))
    )
    return reached.withColumn("start_ms", F.greatest("start_ms", "__reach")).drop("__reach")


def atomic_cells(
    blocks: DataFrame,
    strikes: DataFrame,
    cuts: DataFrame,
    gaps: DataFrame,
    by: str | Sequence[str] = "session_id",
    bin_ms: int = BIN_MS,
    chunk_ms: int = CHUNK_MS,
) -> DataFrame:
    """State of every track in every cell between neighbouring edges (long form).

    A manual cut silences all tracks; then a block speaks for its track, then a
    gap row for all; otherwise the track is ducked.  Blocks of one track that
    disagree give the state ``conflict``.
    """
    by = as_list(by)
    blocks = settle(blocks)
    tracks = blocks.select(*by, "track").distinct()
    edges = (
        _edges(blocks, by)
        .unionByName(_edges(strikes, by))
        .unionByName(_edges(cuts, by))
        .unionByName(_edges(gaps, by))
    )
    grid = settle(_cells_between(edges, by, chunk_ms), 1)

    owner = [*by, "track", "block_id"]
    kept = blocks.filter("keep").select(*owner, "start_ms", "end_ms")
    speaking = subtract_intervals(
        kept, strikes.select(*owner, "start_ms", "end_ms"), owner, 0, bin_ms, chunk_ms, ()
    )
    silenced = (
        blocks.filter("NOT keep")
        .select(*by, "track", "start_ms", "end_ms")
        .unionByName(strikes.select(*by, "track", "start_ms", "end_ms"))
    )
    one_track = (
        speaking.select(*by, "track", "start_ms", "end_ms")
        .withColumn("kind", F.lit(KEEP))
        .unionByName(silenced.withColumn("kind", F.lit(SILENT)))
    )
    shared = cuts.select(*by, "start_ms", "end_ms", F.lit("cut").alias("kind"), F.lit(False).alias("on")).unionByName(
        _leading_parts(gaps.select(*by, "start_ms", "end_ms", F.col("keep").alias("on")), by, chunk_ms).withColumn("kind", F.lit("gap"))
    )
    gap = F.col("kind") == "gap"
    for_all = _openings(
        shared, by, n_cut=F.col("kind") == "cut", n_open=gap & F.col("on"), n_shut=gap & ~F.col("on")
    )
    for_one = _openings(one_track, [*by, "track"], n_keep=F.col("kind") == KEEP, n_silent=F.col("kind") == SILENT)
    counted = _open_counts(grid.join(tracks, by), [*by, "track"], chunk_ms, for_all, for_one)
    state = (
        F.when(F.col("n_cut") > 0, SILENT)
        .when((F.col("n_keep") > 0) & (F.col("n_silent") > 0), CONFLICT)
        .when(F.col("n_keep") > 0, KEEP)
        .when(F.col("n_silent") > 0, SILENT)
        .when(F.col("n_open") > 0, KEEP)
        .when(F.col("n_shut") > 0, SILENT)
        .otherwise(DUCK)
    )
    return counted.select(*by, "a_ms", "b_ms", "track", state.alias("state"))


def conflict_check(cells: DataFrame) -> DataFrame:
    """Cells in which blocks of one track disagree."""
    return cells.filter(F.col("state") == CONFLICT)


def to_wide(cells: DataFrame, by: str | Sequence[str] = "session_id", rank: str | None = None) -> DataFrame:
    """One row per cell with its states in track order."""
    by = as_list(by)
    place = F.col(rank) if rank else F.lit(0)
    entry = F.struct(place.alias("place"), "track", "state")
    listed = cells.groupBy(*by, "a_ms", "b_ms").agg(F.sort_array(F.collect_list(entry)).alias("s"))
    return listed.select(
        *by,
        "a_ms",
        "b_ms",
        F.transform(
            "s", lambda x: F.struct(x["track"].alias("track"), x["state"].alias("state"))
        ).alias("states"),
    )


def has_state(state: str, column: str = "states") -> Column:
    return F.exists(column, lambda x: x["state"] == state)


def _first_keeper() -> Column:
    return F.get(F.filter("states", lambda x: x["state"] == KEEP), 0)["track"]


def merge_cells(
    cells: DataFrame, by: str | Sequence[str] = "session_id", chunk_ms: int = CHUNK_MS
) -> DataFrame:
    """Join touching cells whose states are all equal."""
    by = as_list(by)
    chunk = time_chunk("a_ms", chunk_ms)
    lagged = with_neighbours(
        cells, by, ["a_ms"], chunk, previous={"p_b": "b_ms", "p_states": "states"}
    )
    same = (F.col("p_b") == F.col("a_ms")) & (F.col("p_states") == F.col("states"))
    opens = F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)
    numbered = scan(lagged, by, ["a_ms"], chunk, island=running_sum(opens))
    return numbered.groupBy(*by, "island").agg(
        F.min("a_ms").alias("a_ms"), F.max("b_ms").alias("b_ms"), F.first("states").alias("states")
    ).drop("island")


def _recut(
    cells: DataFrame, extra: DataFrame, by: list[str], chunk_ms: int
) -> DataFrame:
    """Open ``extra(track, start_ms, end_ms)`` on ducked tracks, cutting cells as needed.

    Time outside the old cells starts ducked.  A silent track stays silent.
    """
    cells = settle(cells, 1)
    extra = settle(extra.filter("end_ms > start_ms"), 1)
    grid = settle(
        _cells_between(
            _edges(cells, by, "a_ms", "b_ms").unionByName(_edges(extra, by)), by, chunk_ms
        ),
        1,
    )
    # the cell that a place lies in is the last that began, if that has not ended
    began = cells.select(*by, "a_ms", F.struct(F.col("b_ms").alias("until"), "states").alias("__cell"))
    placed = scan(
        grid.join(began, [*by, "a_ms"], "left"),
        by,
        ["a_ms"],
        time_chunk("a_ms", chunk_ms),
        __in=nearest_value(F.col("__cell"), inclusive=True),
    ).select(*by, "a_ms", "b_ms", F.when(F.col("__in.until") > F.col("a_ms"), F.col("__in.states")).alias("states"))
    blank = cells.groupBy(*by).agg(
        F.min_by(
            F.transform(
                "states", lambda x: F.struct(x["track"].alias("track"), F.lit(DUCK).alias("state"))
            ),
            "a_ms",
        ).alias("__blank")
    )
    tracks = blank.select(*by, F.explode("__blank.track").alias("track"))
    opening = _openings(extra, [*by, "track"], n_open=F.lit(True))
    swept = _open_counts(grid.join(tracks, by), [*by, "track"], chunk_ms, opening)
    opened = swept.filter("n_open > 0").groupBy(*by, "a_ms").agg(F.collect_set("track").alias("__open"))
    joined = placed.join(opened, [*by, "a_ms"], "left").join(blank, by)
    start = F.coalesce("states", "__blank")
    lifted = F.transform(
        start,
        lambda x: F.struct(
            x["track"].alias("track"),
            F.when(
                (x["state"] == DUCK) & F.coalesce(F.array_contains("__open", x["track"]), F.lit(False)),
                KEEP,
            )
            .otherwise(x["state"])
            .alias("state"),
        ),
    )
    return merge_cells(joined.select(*by, "a_ms", "b_ms", lifted.alias("states")), by, chunk_ms)


def _idle_runs(cells: DataFrame, by: list[str], chunk_ms: int) -> DataFrame:
    """Cells nobody keeps, with the keeping cells around them."""
    keeper = F.when(
        has_state(KEEP), F.struct("a_ms", "b_ms", _first_keeper().alias("who"))
    )
    around = scan(
        cells,
        by,
        ["a_ms"],
        time_chunk("a_ms", chunk_ms),
        before=nearest_value(keeper),
        after=nearest_value(keeper, reverse=True),
    )
    return around.filter(~has_state(KEEP))


def activity_mask(
    cells: DataFrame,
    by: str | Sequence[str] = "session_id",
    hold_ms: int = 900,
    lookahead_ms: int = 50,
    hangover_ms: int = 150,
    chunk_ms: int = CHUNK_MS,
) -> DataFrame:
    """Bridge short idle runs and widen what is kept; only ducked time opens.

    A run up to ``hold_ms`` is held by the track kept before it, else by the one
    after it.  Then kept time opens ``lookahead_ms`` early and closes
    ``hangover_ms`` late.
    """
    by = as_list(by)
    cells = settle(cells, 1)
    span = cells.groupBy(*by).agg(F.min("a_ms").alias("lo"), F.max("b_ms").alias("hi"))
    idle = _idle_runs(cells, by, chunk_ms).join(span, by)
    run_a = F.coalesce("before.b_ms", "lo")
    run_b = F.coalesce("after.a_ms", "hi")
    held = idle.filter(run_b - run_a <= hold_ms).select(
        *by,
        F.coalesce("before.who", "after.who").alias("track"),
        F.col("a_ms").alias("start_ms"),
        F.col("b_ms").alias("end_ms"),
    ).filter("track IS NOT NULL")
    bridged = settle(_recut(cells, held, by, chunk_ms), 1)

    kept = (
        bridged.select(*by, "a_ms", "b_ms", F.explode("states").alias("s"))
        .filter(F.col("s.state") == KEEP)
        .select(*by, F.col("s.track").alias("track"), F.col("a_ms").alias("start_ms"), F.col("b_ms").alias("end_ms"))
    )
    runs = merge_intervals(kept, [*by, "track"], 0, True, chunk_ms=chunk_ms).join(span, by)
    wide = runs.select(
        *by,
        "track",
        F.greatest("lo", F.col("start_ms") - lookahead_ms).alias("start_ms"),
        F.least(F.col("hi") + hangover_ms, F.col("end_ms") + hangover_ms).alias("end_ms"),
    )
    return _recut(bridged, wide, by, chunk_ms)


def _idle_summary(cells: DataFrame, by: list[str], chunk_ms: int) -> DataFrame:
    idle = _idle_runs(cells, by, chunk_ms)
    return idle.groupBy(*by, F.col("before.b_ms").alias("__run")).agg(
        F.min("a_ms").alias("start_ms"),
        F.max("b_ms").alias("end_ms"),
        F.bool_or(has_state(SILENT)).alias("has_silent"),
        F.first("before.who").alias("prev_track"),
        F.first("after.who").alias("next_track"),
    ).drop("__run")


def resolve_time(
    cells: DataFrame,
    by: str | Sequence[str] = "session_id",
    max_pause_ms: int = 900,
    pause_keep_ms: int = 600,
    bin_ms: int = BIN_MS,
    chunk_ms: int = CHUNK_MS,
) -> DataFrame:
    """Cells that stay on the common time axis.

    Kept time stays.  An idle run goes when a track silenced it or when it lies
    before the first or after the last kept time; a longer one is shortened to
    ``pause_keep_ms``, its halves held by the neighbours.
    """
    by = as_list(by)
    cells = settle(cells, 1)
    idle = settle(_idle_summary(cells, by, chunk_ms), 1)
    half = pause_keep_ms // 2
    outer = F.col("prev_track").isNull() | F.col("next_track").isNull()
    whole = F.col("has_silent") | outer
    long = ~whole & (F.col("end_ms") - F.col("start_ms") > max_pause_ms)
    drops = idle.filter(whole | long).select(
        *by,
        F.when(whole, F.col("start_ms")).otherwise(F.col("start_ms") + half).alias("start_ms"),
        F.when(whole, F.col("end_ms")).otherwise(F.col("end_ms") - half).alias("end_ms"),
    )
    halves = F.explode(
        F.array(
            F.struct(
                F.col("prev_track").alias("track"),
                F.col("start_ms").alias("a"),
                (F.col("start_ms") + half).alias("b"),
            ),
            F.struct(
                F.col("next_track").alias("track"),
                (F.col("end_ms") - half).alias("a"),
                F.col("end_ms").alias("b"),
            ),
        )
    )
    extra = (
        idle.filter(long)
        .select(*by, halves.alias("h"))
        .select(*by, "h.track", F.col("h.a").alias("start_ms"), F.col("h.b").alias("end_ms"))
    )
    opened = _recut(cells, extra, by, chunk_ms).withColumnsRenamed(
        {"a_ms": "start_ms", "b_ms": "end_ms"}
    )
    left = subtract_intervals(opened, drops, by, 0, bin_ms, chunk_ms, ("start_ms",))
    kept = left.filter(has_state(KEEP) | ~has_state(SILENT))
    return merge_cells(
        kept.withColumnsRenamed({"start_ms": "a_ms", "end_ms": "b_ms"}), by, chunk_ms
    )


def retained_ranges(
    cells: DataFrame, by: str | Sequence[str] = "session_id", chunk_ms: int = CHUNK_MS
) -> DataFrame:
    spans = cells.select(*as_list(by), F.col("a_ms").alias("start_ms"), F.col("b_ms").alias("end_ms"))
    return merge_intervals(spans, by, 0, True, chunk_ms=chunk_ms).drop("parts")


def gain_envelope(
    cells: DataFrame,
    by: str | Sequence[str] = "session_id",
    duck_db: float = -27.0,
    silent_db: float = -60.0,
    chunk_ms: int = CHUNK_MS,
) -> DataFrame:
    """Gain of each track on the output axis, where retained cells follow each other."""
    by = as_list(by)
    length = F.col("b_ms") - F.col("a_ms")
    placed = settle(
        scan(
            cells,
            by,
            ["a_ms"],
            time_chunk("a_ms", chunk_ms),
            bus_a=running_sum(length, inclusive=False),
        ),
        1,
    )
    gain = (
        F.when(F.col("s.state") == KEEP, 0.0).when(F.col("s.state") == DUCK, duck_db).otherwise(silent_db)
    )
    steps = placed.select(
        *by, "bus_a", (F.col("bus_a") + length).alias("bus_b"), F.explode("states").alias("s")
    ).select(*by, F.col("s.track").alias("track"), "bus_a", "bus_b", gain.alias("gain_db"))
    keys = [*by, "track"]
    chunk = time_chunk("bus_a", chunk_ms)
    lagged = with_neighbours(steps, keys, ["bus_a"], chunk, previous={"p_gain": "gain_db"})
    opens = F.when(F.col("p_gain") == F.col("gain_db"), 0).otherwise(1)
    numbered = scan(lagged, keys, ["bus_a"], chunk, part=running_sum(opens))
    return numbered.groupBy(*keys, "part").agg(
        F.min("bus_a").alias("bus_start_ms"),
        F.max("bus_b").alias("bus_end_ms"),
        F.first("gain_db").alias("gain_db"),
    ).drop("part")
