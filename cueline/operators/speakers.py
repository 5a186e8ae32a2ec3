"""Who speaks when: attaching turns, words and cues to each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.operators.cleaning import flag_artifacts
from cueline.operators.intervals import BIN_MS, interval_join, overlap_ms
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
    with_position,
)
from cueline.session import settle

DEFAULT_SPEAKER = "S1"


def rank_speakers(turns: DataFrame, by: str | Sequence[str] = "session_id") -> DataFrame:
    """Rename speakers S1, S2, ... by total talking time, most first.

    Ties go to the speaker heard first.  Returns the mapping; the number of
    speakers of a session is small by nature.
    """
    by = as_list(by)
    totals = (
        turns.groupBy(*by, "speaker")
        .agg(
            F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"),
            F.min(F.struct("start_ms", "turn_idx")).alias("first"),
        )
        .withColumn("less", -F.col("total_ms"))
    )
    placed = with_position(
        totals, by, ["less", "first", "speaker"], time_chunk("less", 3_600_000), "place"
    )
    return placed.select(
        *by, "speaker", "total_ms", F.concat(F.lit("S"), F.col("place").cast("string")).alias("label")
    )


def apply_name_map(
    df: DataFrame, mapping: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Replace speaker labels found in ``mapping(speaker, name)``, keep the rest."""
    named = df.join(mapping, [*by, "speaker"], "left")
    return named.withColumn("speaker", F.coalesce("name", "speaker")).drop("name")


def speaker_switches(
    cues: DataFrame,
    by: str | Sequence[str] = "session_id",
    order: Sequence[str] = ("idx",),
    chunk: Column | None = None,
) -> DataFrame:
    """Number of adjacent cues whose speakers differ."""
    by = as_list(by)
    chunk = time_chunk("idx", 512) if chunk is None else chunk
    lagged = with_neighbours(cues, by, order, chunk, previous={"prev": "speaker"})
    return lagged.groupBy(*by).agg(
        F.count_if(F.col("prev").isNotNull() & (F.col("prev") != F.col("speaker"))).alias(
            "switches"
        )
    )


def nearest_join(
    points: DataFrame,
    intervals: DataFrame,
    by: str | Sequence[str] = "session_id",
    key: Sequence[str] = ("idx",),
    rank: str = "turn_idx",
    value: str = "speaker",
    chunk_ms: int = CHUNK_MS,
) -> DataFrame:
    """The interval with an endpoint closest to the middle of each point span.

    Distances are doubled so they stay whole numbers.  Ties go to the lower
    ``rank``.
    """
    by, key = as_list(by), list(key)
    ends = intervals.select(
        *by,
        F.explode(F.array("start_ms", "end_ms")).alias("t"),
        rank,
        F.col(value).alias("__v"),
    )
    ends = (
        ends.groupBy(*by, "t")
        .agg(F.min(F.struct(F.col(rank).alias("r"), F.col("__v").alias("v"))).alias("m"))
        .select(*by, (F.col("t") * 2).alias("t2"), F.lit(0).alias("k"), "m")
    )
    dtypes = dict(points.dtypes)
    marks = ends.select(
        *by,
        "t2",
        "k",
        *[F.lit(None).cast(dtypes[c]).alias(c) for c in key],
        F.struct("t2", "m").alias("mark"),
    )
    asked = points.select(
        *by,
        (F.col("start_ms") + F.col("end_ms")).alias("t2"),
        F.lit(1).alias("k"),
        *key,
        F.lit(None).cast(marks.schema["mark"].dataType).alias("mark"),
    )
    seen = scan(
        marks.unionByName(asked),
        by,
        ["t2", "k", *key],
        time_chunk("t2", 2 * chunk_ms),
        left=nearest_value(F.col("mark")),
        right=nearest_value(F.col("mark"), reverse=True),
    ).filter(F.col("k") == 1)

    def option(side: str) -> Column:
        return F.when(
            F.col(side).isNotNull(),
            F.struct(
                F.abs(F.col(f"{side}.t2") - F.col("t2")).alias("dist2"),
                F.col(f"{side}.m.r").alias("r"),
                F.col(f"{side}.m.v").alias("v"),
            ),
        )

    best = F.least(option("left"), option("right"))
    return seen.select(*by, *key, best.alias("best")).select(
        *by,
        *key,
        F.col("best.dist2").alias("dist2"),
        F.col("best.r").alias(rank),
        F.col("best.v").alias(value),
    )


def _best_overlap(
    spans: DataFrame, turns: DataFrame, by: list[str], key: list[str], bin_ms: int
) -> DataFrame:
    # Copies of one turn are reduced to the first before the join.
    distinct = turns.groupBy(*by, "start_ms", "end_ms").agg(
        F.min(F.struct("turn_idx", "speaker")).alias("first")
    ).select(*by, "start_ms", "end_ms", "first.turn_idx", "first.speaker")
    narrow = spans.select(*by, *key, "start_ms", "end_ms")
    pairs = interval_join(narrow, distinct, by, bin_ms).withColumn("ov", overlap_ms())
    return (
        pairs.filter(F.col("ov") > 0)
        .groupBy(*by, *key)
        .agg(
            F.max(F.struct("ov", (-F.col("r_turn_idx")).alias("n"), "r_speaker")).alias("best")
        )
        .select(
            *by,
            *key,
            F.col("best.r_speaker").alias("matched"),
            F.col("best.ov").alias("overlap_ms"),
        )
    )


def assign_by_max_overlap(
    cues: DataFrame,
    turns: DataFrame,
    by: str | Sequence[str] = "session_id",
    key: Sequence[str] = ("idx",),
    default: str = DEFAULT_SPEAKER,
    bin_ms: int = BIN_MS,
) -> DataFrame:
    """Give each cue the speaker of the turn it overlaps most.

    Without overlap the turn with the nearest endpoint decides; a session
    without turns gets ``default``.
    """
    by, key = as_list(by), list(key)
    best = settle(_best_overlap(cues, turns, by, key, bin_ms))
    joined = cues.drop("speaker").join(best, [*by, *key], "left")
    lonely = cues.join(best, [*by, *key], "left_anti")
    nearest = nearest_join(lonely, turns, by, key).select(
        *by, *key, F.col("speaker").alias("nearest")
    )
    return (
        joined.join(nearest, [*by, *key], "left")
        .withColumn("speaker", F.coalesce("matched", "nearest", F.lit(default)))
        .withColumn("overlap_ms", F.coalesce("overlap_ms", F.lit(0).cast("bigint")))
        .drop("matched", "nearest")
    )


def label_words(
    words: DataFrame,
    turns: DataFrame,
    by: str | Sequence[str] = "session_id",
    key: Sequence[str] = ("idx", "pos"),
    default: str = DEFAULT_SPEAKER,
    bin_ms: int = BIN_MS,
    chunk_ms: int = CHUNK_MS,
) -> DataFrame:
    """Speaker per word; a word without overlap inherits the previous label.

    Only the first word of a session can look for the nearest turn.
    """
    by, key = as_list(by), list(key)
    order = ["start_ms", *key]
    best = settle(_best_overlap(words, turns, by, key, bin_ms).drop("overlap_ms"), 1)
    opening = words.groupBy(*by).agg(
        F.min_by(F.struct(*key, "start_ms", "end_ms"), F.struct(*order)).alias("w")
    )
    first = opening.select(*by, "w.*")
    lonely = first.join(best, [*by, *key], "left_anti")
    near = nearest_join(lonely, turns, by, key).select(*by, *key, F.col("speaker").alias("near"))
    opener = first.select(*by, *key, F.lit(default).alias("__d")).join(near, [*by, *key], "left")
    seeded = (
        words.join(best, [*by, *key], "left")
        .join(opener, [*by, *key], "left")
        .withColumn("seed", F.coalesce("matched", "near", "__d"))
    )
    filled = scan(
        seeded.select(*words.columns, "seed"),
        by,
        order,
        time_chunk("start_ms", chunk_ms),
        label=nearest_value(F.col("seed"), inclusive=True),
    )
    return filled.drop("seed")


def words_to_cues(
    words: DataFrame,
    cues: DataFrame,
    by: str | Sequence[str] = "session_id",
    key: Sequence[str] = ("idx", "pos"),
    cue_key: str = "idx",
    chunk_ms: int = CHUNK_MS,
) -> DataFrame:
    """The first cue that has not ended when the word starts; late words drop.

    Only cues that end after every earlier cue can be that first cue.
    """
    by, key = as_list(by), list(key)
    reach = scan(
        cues.select(*by, F.col(cue_key).alias("cue"), "end_ms"),
        by,
        ["cue"],
        time_chunk("cue", 512),
        reach=running_max(F.col("end_ms")),
    ).filter(F.col("reach").isNull() | (F.col("end_ms") > F.col("reach")))
    dtypes = dict(words.dtypes)
    extra = [c for c in words.columns if c not in by]
    marks = reach.select(
        *by,
        F.col("end_ms").alias("__t"),
        F.lit(1).alias("__k"),
        *[F.lit(None).cast(dtypes[c]).alias(c) for c in extra],
        F.col("cue").alias("__cue"),
    )
    asked = words.select(
        *by,
        F.col("start_ms").alias("__t"),
        F.when(F.col("end_ms") <= F.col("start_ms"), 0).otherwise(2).alias("__k"),
        *extra,
        F.lit(None).cast("bigint").alias("__cue"),
    )
    seen = scan(
        marks.unionByName(asked),
        by,
        ["__t", "__k", *key],
        time_chunk("__t", chunk_ms),
        cue_idx=nearest_value(F.col("__cue"), reverse=True),
    )
    return seen.filter((F.col("__k") != 1) & F.col("cue_idx").isNotNull()).select(
        *words.columns, "cue_idx"
    )


def words_in_block(
    words: DataFrame,
    blocks: DataFrame,
    by: str | Sequence[str] = "session_id",
    bin_ms: int = BIN_MS,
) -> DataFrame:
    """Pairs where the middle of the word lies in ``[start, end)`` of the block."""
    by = as_list(by)
    middles = words.withColumn("__a", F.col("start_ms") + F.col("end_ms")).withColumn(
        "__b", F.col("__a") + 1
    )
    doubled = blocks.withColumn("a2", F.col("start_ms") * 2).withColumn("b2", F.col("end_ms") * 2)
    return interval_join(
        middles, doubled, by, 2 * bin_ms, left_span=("__a", "__b"), right_span=("a2", "b2")
    ).drop("__a", "__b", "r_a2", "r_b2")


def joined_text(words: Column, reference: Column) -> Column:
    """Concatenate word strings, restoring a space the reference text has.

    A space goes back between two plain alphanumeric edges only when the last
    piece, a space and the next word occur together in the reference.
    """
    ends = F.lit("[A-Za-z0-9]$")
    begins = F.lit("^[A-Za-z0-9]")
    start = F.struct(F.lit("").alias("text"), F.lit("").alias("last"))

    def add(acc: Column, word: Column) -> Column:
        spaced = (
            F.regexp_like(acc["last"], ends)
            & F.regexp_like(word, begins)
            & F.contains(reference, F.concat(acc["last"], F.lit(" "), word))
        )
        return F.struct(
            F.concat(acc["text"], F.when(spaced, " ").otherwise(""), word).alias("text"),
            word.alias("last"),
        )

    return F.aggregate(words, start, add, lambda acc: acc["text"])


def split_at_speaker_change(
    cues: DataFrame,
    turns: DataFrame,
    words: DataFrame,
    by: str | Sequence[str] = "session_id",
    glue_ms: int = 50,
    bin_ms: int = BIN_MS,
    chunk_ms: int = CHUNK_MS,
) -> DataFrame:
    """Cut cues where the speaker of their words changes.

    Outer edges keep the cue's own bounds; a cue with one speaker is unchanged.
    Afterwards neighbours of one speaker that split a plain word are glued.
    """
    by = as_list(by)
    labelled = label_words(words, turns, by, bin_ms=bin_ms, chunk_ms=chunk_ms)
    placed = words_to_cues(labelled, cues, by, chunk_ms=chunk_ms)
    order = ["start_ms", "idx", "pos"]
    in_cue = [*by, "cue_idx"]
    # the words of one cue are few, as its text is: they meet in one place, in order, and their parts stay there
    in_order = Window.partitionBy(*in_cue).orderBy(*order)
    lagged = placed.withColumn("prev_label", F.lag("label").over(in_order))
    opens = F.col("prev_label").isNull() | (F.col("prev_label") != F.col("label"))
    part = F.sum(F.when(opens, 1).otherwise(0)).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    runs = lagged.withColumn("part", part).withColumn("parts", F.max("part").over(Window.partitionBy(*in_cue)))
    # a cue with one part keeps its text, so its words are not collected
    in_part = Window.partitionBy(*in_cue, "part").orderBy(*order)
    whole = in_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = (
        runs.select(
            *in_cue,
            "part",
            "parts",
            "label",
            F.col("start_ms").alias("first_ms"),
            F.last("end_ms").over(whole).alias("last_ms"),
            F.collect_list(F.when(F.col("parts") > 1, F.struct("word"))).over(whole).alias("__words"),
            F.row_number().over(in_part).alias("__no"),
        )
        .filter("__no = 1")
        .drop("__no")
    )
    joined = cues.withColumnRenamed("speaker", "own").join(
        parts.withColumnRenamed("cue_idx", "idx"), [*by, "idx"], "left"
    )
    many = F.coalesce(F.col("parts"), F.lit(1)) > 1
    # each part starts no earlier than the previous one ended; the chain of
    # maxima is a running maximum over starts and ends seen so far
    bounded = joined.select(
        *by,
        "idx",
        F.coalesce("part", F.lit(1)).alias("part"),
        F.coalesce("label", "own").alias("speaker"),
        F.when(many, joined_text(F.col("__words.word"), F.col("text")))
        .otherwise(F.col("text"))
        .alias("text"),
        "start_ms",
        "end_ms",
        "first_ms",
        "last_ms",
        many.alias("many"),
        (F.col("part") == F.col("parts")).alias("is_last"),
    )
    reach = F.when(
        F.col("part") == 1, F.greatest("start_ms", "last_ms")
    ).otherwise(F.greatest("first_ms", "last_ms"))
    earlier = Window.partitionBy(*by, "idx").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    chained = bounded.withColumn("prev_end", F.max(reach).over(earlier))
    start = F.when(~F.col("many") | (F.col("part") == 1), F.col("start_ms")).otherwise(
        F.greatest("first_ms", "prev_end")
    )
    end = F.when(~F.col("many") | F.col("is_last"), F.col("end_ms")).otherwise(
        F.greatest("last_ms", start)
    )
    pieces = chained.select(
        *by, "idx", "part", "speaker", "text", start.alias("start_ms"), end.alias("end_ms")
    )
    return glue_split_words(pieces, by, glue_ms)


def glue_split_words(
    pieces: DataFrame, by: Sequence[str], glue_ms: int = 50, rows: int = 512
) -> DataFrame:
    """Join neighbouring pieces of one speaker that cut a plain word in two."""
    by = list(by)
    order = ["idx", "part"]
    chunk = time_chunk("idx", rows)
    lagged = with_neighbours(
        pieces,
        by,
        order,
        chunk,
        previous={"p_speaker": "speaker", "p_end": "end_ms", "p_text": "text"},
    )
    glued = (
        (F.col("p_speaker") == F.col("speaker"))
        & (F.col("start_ms") - F.col("p_end") <= glue_ms)
        & F.regexp_like(F.col("p_text"), F.lit("[A-Za-z0-9]$"))
        & F.regexp_like(F.col("text"), F.lit("^[A-Za-z0-9]"))
    )
    opens = F.when(F.coalesce(glued, F.lit(False)), 0).otherwise(1)
    numbered = scan(lagged, by, order, chunk, no=running_sum(opens))
    return numbered.groupBy(*by, "no").agg(
        F.min_by("start_ms", F.struct(*order)).alias("start_ms"),
        F.max_by("end_ms", F.struct(*order)).alias("end_ms"),
        F.min_by("speaker", F.struct(*order)).alias("speaker"),
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct(*order, "text"))), lambda p: p["text"]
            ),
            "",
        ).alias("text"),
    ).withColumnRenamed("no", "idx")


def insert_blocks(
    cues: DataFrame, speaker: str, by: str | Sequence[str] = "session_id"
) -> DataFrame:
    """Blocks of a separately recorded insert: fixed speaker, own numbering.

    Recogniser loops are marked as in the main recording, with the mark as the reason.
    """
    by = as_list(by)
    numbered = with_position(cues, by, ["idx"], time_chunk("idx", 512), "no")
    text = F.trim("text")
    blocks = numbered.filter(F.length(text) > 0).select(
        *by,
        F.format_string("S%04d", "no").alias("block_id"),
        "start_ms",
        "end_ms",
        F.lit(speaker).alias("speaker"),
        text.alias("text"),
        F.lit(True).alias("keep"),
        F.lit("").alias("reason"),
    )
    return flag_artifacts(blocks)
