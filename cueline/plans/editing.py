"""Comparing and validating edit plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueline.functions import constants as k
from cueline.functions import text as tx
from cueline.operators.scan import as_list, row_chunk, running_sum, scan
from cueline.session import cut_lineage, settle


def strike_count(raw: Column) -> Column:
    return F.floor((F.size(F.split(raw, "~~", -1)) - 1) / 2).cast("bigint")


def plan_diff(
    old: dict[str, DataFrame], new: dict[str, DataFrame], by: str | Sequence[str] = "session_id"
) -> DataFrame:
    """Semantic differences of two plan versions in long form.

    A version holds ``blocks(block_id, keep, raw)``, ``cuts(a_ms, b_ms)`` and
    ``params(scope, name, value)`` (settings and music parameters).  Rows are
    ``(kind, item, was, now)``.
    """
    by = as_list(by)
    a = old["blocks"].select(
        *by, "block_id", F.col("keep").alias("a_keep"), strike_count(F.col("raw")).alias("a_n")
    )
    b = new["blocks"].select(
        *by, "block_id", F.col("keep").alias("b_keep"), strike_count(F.col("raw")).alias("b_n")
    )
    pairs = a.join(b, [*by, "block_id"], "full_outer")
    in_a, in_b = F.col("a_keep").isNotNull(), F.col("b_keep").isNotNull()

    def row(kind: str, when: Column, was: Column, now: Column) -> Column:
        made = F.struct(
            F.lit(kind).alias("kind"),
            was.cast("string").alias("was"),
            now.cast("string").alias("now"),
        )
        return F.when(when, made)

    a_n, b_n = F.coalesce("a_n", F.lit(0)), F.coalesce("b_n", F.lit(0))
    found = F.array(
        row("keep", in_a & in_b & (F.col("a_keep") != F.col("b_keep")), F.col("a_keep"), F.col("b_keep")),
        row("strikes", a_n != b_n, a_n, b_n),
        row("only_one_side", in_a != in_b, in_a, in_b),
    )
    block_rows = pairs.select(
        *by, F.col("block_id").alias("item"), F.explode(F.filter(found, lambda r: r.isNotNull())).alias("r")
    ).select(*by, "r.kind", "item", "r.was", "r.now")

    def cut_rows(have: DataFrame, other: DataFrame, kind: str) -> DataFrame:
        item = F.concat_ws("-", F.col("a_ms").cast("string"), F.col("b_ms").cast("string"))
        return have.subtract(other).select(
            *by,
            F.lit(kind).alias("kind"),
            item.alias("item"),
            F.lit(str(kind == "cut_removed").lower()).alias("was"),
            F.lit(str(kind == "cut_added").lower()).alias("now"),
        )

    ca, cb = (v["cuts"].select(*by, "a_ms", "b_ms") for v in (old, new))
    pa = old["params"].select(*by, "scope", "name", F.col("value").alias("was"))
    pb = new["params"].select(*by, "scope", "name", F.col("value").alias("now"))
    params = (
        pa.join(pb, [*by, "scope", "name"], "full_outer")
        .filter(~F.col("was").eqNullSafe(F.col("now")))
        .select(
            *by, F.lit("param").alias("kind"), F.concat_ws(".", "scope", "name").alias("item"), "was", "now"
        )
    )
    return (
        block_rows.unionByName(cut_rows(ca, cb, "cut_removed"))
        .unionByName(cut_rows(cb, ca, "cut_added"))
        .unionByName(params)
    )


def changed_blocks(
    old: DataFrame,
    new: DataFrame,
    by: str | Sequence[str] = "session_id",
    resegment_ratio: float = 0.3,
) -> DataFrame:
    """Blocks worth listening to again: ``(block_id, change, resegmented)``.

    Inputs have ``block_id, keep, spans`` (the struck spans).  New kept blocks
    count unless so many ids are new that the plan was cut anew.
    """
    by = as_list(by)
    o = old.select(*by, "block_id", F.col("keep").alias("o_keep"), F.col("spans").alias("o_spans"))
    n = settle(new.select(*by, "block_id", "keep", "spans").join(o, [*by, "block_id"], "left"))
    fresh = F.col("o_keep").isNull()
    share = n.groupBy(*by).agg(
        (F.count_if(fresh) > F.greatest(F.lit(1.0), F.count("*") * resegment_ratio)).alias("resegmented")
    )
    delta = F.size("spans") - F.size("o_spans")
    sign = F.when(delta > 0, "＋").otherwise("−")
    amount = F.when(delta == 0, "調整").otherwise(F.abs(delta).cast("string"))
    change = (
        F.when(fresh, F.when(~F.col("resegmented") & F.col("keep"), k.CHANGE_LABELS["added"]))
        .when(
            F.col("o_keep") != F.col("keep"),
            F.when(F.col("keep"), k.CHANGE_LABELS["restored"]).otherwise(k.CHANGE_LABELS["cut"]),
        )
        .when(F.col("o_spans") != F.col("spans"), F.concat(F.lit("字級精剪"), sign, amount))
    )
    return (
        n.join(share, by)
        .select(*by, "block_id", change.alias("change"), "resegmented")
        .filter("change IS NOT NULL")
    )


def transcript_chunks(cues: DataFrame, by: str | Sequence[str] = "session_id", size: int = 4096) -> DataFrame:
    """The transcript without white space, cut into ``size`` characters: ``(chunk, flat)``."""
    by = as_list(by)
    flat = cues.select(*by, "idx", tx.no_space(F.col("text")).alias("t")).filter("t <> ''")
    placed = scan(flat, by, ["idx"], row_chunk("idx"), at=running_sum(F.length("t").cast("bigint"), inclusive=False))
    first = F.coalesce("at", F.lit(0))
    chunks = F.explode(F.sequence(F.floor(first / size), F.floor((first + F.length("t") - 1) / size)))
    parts = placed.select(*by, "t", first.alias("at"), chunks.alias("chunk"))
    begin = F.greatest(F.col("at"), F.col("chunk") * size)
    end = F.least(F.col("at") + F.length("t"), (F.col("chunk") + 1) * size)
    piece = F.substr("t", (begin - F.col("at") + 1).cast("int"), (end - begin).cast("int"))
    return (
        parts.groupBy(*by, "chunk")
        .agg(F.array_sort(F.collect_list(F.struct(begin.alias("p"), piece.alias("t")))).alias("ps"))
        .select(*by, "chunk", F.array_join(F.transform("ps", lambda x: x["t"]), "").alias("flat"))
    )


#: Characters in which a position is looked for; a substring is found by counting from the start of its text.
STRETCH = 64


def _piece_hashes(text: Column, count: Column, length: Column, step: int = 1) -> Column:
    """Hashes of the pieces of ``length`` characters that begin at every ``step``-th of the first ``count``: ``(p, h)``, ``p`` from 0."""

    def of_stretch(first: Column) -> Column:
        # bound to a lambda's variable, the stretch is cut once and not for every piece
        near = F.array(F.substr(text, first + 1, F.lit(STRETCH) + length))
        places = F.sequence(F.lit(0), F.least(F.lit(STRETCH), count - first) - 1, F.lit(step))
        hashed = lambda own: F.transform(
            places, lambda i: F.struct((first + i).alias("p"), F.xxhash64(F.substr(own, i + 1, length)).alias("h"))
        )
        return F.transform(near, hashed)[0]

    firsts = F.sequence(F.lit(0), count - 1, F.lit(STRETCH))
    return F.when(count > 0, F.flatten(F.transform(firsts, of_stretch)))


def _spans(candidates: DataFrame, size: int) -> DataFrame:
    """Candidates ``(at, flat)`` cut by the chunks of the transcript, each with its own characters only: ``(chunk, from, own)``."""
    last = F.floor((F.col("at") + F.length("flat") - 1) / size)
    first = F.floor(F.col("at") / size)
    placed = candidates.withColumn("chunk", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("at"), F.col("chunk") * size)
    end = F.least(F.col("at") + F.length("flat"), (F.col("chunk") + 1) * size)
    return placed.select(
        *[c for c in placed.columns if c != "flat"],
        (begin - F.col("chunk") * size).cast("int").alias("from"),
        F.substr("flat", (begin - F.col("at") + 1).cast("int"), (end - begin).cast("int")).alias("own"),
    )


def not_in_transcript(
    texts: DataFrame, cues: DataFrame, by: Sequence[str], ident: Sequence[str], gram: int = 24, size: int = 4096, step: int = 8
) -> DataFrame:
    """Those of ``texts(flat)`` that stand nowhere in their transcript, whatever their length.

    At every ``step``-th position of the transcript a piece of ``gram - step + 1`` characters is kept; wherever a text of
    ``gram`` characters stands, one of the first ``step`` pieces of its opening is among them.  A text shorter than ``gram``
    is looked for at every position.  The places found are then compared chunk by chunk.
    """
    by, ident = list(by), list(ident)
    piece = F.lit(gram - step + 1)
    # read for the long, the short and the missing ones
    wanted = settle(texts.filter("flat <> ''"))
    long = F.length("flat") >= gram
    chunks = cut_lineage(transcript_chunks(cues, by, size))
    follow = chunks.select(*by, (F.col("chunk") - 1).alias("chunk"), F.substring("flat", 1, gram - 1).alias("next"))
    reaching = chunks.join(follow, [*by, "chunk"], "left").select(
        *by, (F.col("chunk") * size).alias("first"), F.length("flat").alias("own"), F.concat("flat", F.coalesce("next", F.lit(""))).alias("reach")
    )
    # chunks begin at multiples of the step, and so do the pieces kept of the whole transcript
    starts = F.least("own", F.length("reach") - piece + 1)
    kept = reaching.select(*by, "first", F.explode(_piece_hashes(F.col("reach"), starts, piece, step)).alias("x"))
    begun_long = (
        wanted.filter(long)
        .select(*by, *[c for c in ident if c not in by], "flat", F.explode(_piece_hashes(F.substring("flat", 1, gram), F.lit(step), piece)).alias("o"))
        .withColumn("h", F.col("o.h"))
        .join(kept.select(*by, F.col("x.h").alias("h"), (F.col("first") + F.col("x.p")).alias("found")), [*by, "h"])
        .select(*ident, "flat", (F.col("found") - F.col("o.p")).alias("at"))
    )
    short = wanted.filter(~long).withColumn("n", F.length("flat")).withColumn("h", F.xxhash64("flat"))
    openings = reaching.join(short.select(*by, "n").distinct(), by).select(
        *by, "first", "n", F.explode(_piece_hashes(F.col("reach"), F.col("own"), F.col("n"))).alias("x")
    )
    begun_short = short.join(openings.select(*by, "first", "n", F.col("x.p").alias("p"), F.col("x.h").alias("h")), [*by, "n", "h"]).select(
        *ident, "flat", (F.col("first") + F.col("p")).alias("at")
    )
    begun = begun_long.filter("at >= 0").unionByName(begun_short)
    found = (
        _spans(begun, size)
        .join(chunks.withColumnRenamed("flat", "there"), [*by, "chunk"], "left")
        .withColumn("same", F.coalesce(F.col("own") == F.substr("there", F.col("from") + 1, F.length("own")), F.lit(False)))
        .groupBy(*ident, "at")
        .agg(F.bool_and("same").alias("same"))
        .filter("same")
        .select(*ident)
        .distinct()
    )
    return wanted.join(found, ident, "left_anti").select(*ident)


def validate_plan(
    blocks: DataFrame,
    program: DataFrame,
    cues: DataFrame,
    by: str | Sequence[str] = "session_id",
    gaps: DataFrame | None = None,
    inserts: DataFrame | None = None,
) -> DataFrame:
    """Problems of an edited plan: ``(block_id, problem)``.

    ``blocks(block_id, text)``, with ``kind`` where not all is speech, is what was cut, ``program(block_id, keep, raw)``
    the edited rows.  Every block must be in the program, and every row of the program a block, a gap
    of ``gaps(block_id)`` or a block of ``inserts(block_id, text)``, whose ids begin with S and digits.  Text may
    only gain strike markers; kept speech must occur in the transcript.  The text of gaps is not looked at.
    """
    by = as_list(by)
    ident = [*by, "block_id"]

    def problem(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*ident, F.lit(name).alias("problem"))

    inserted = F.regexp_like("block_id", F.lit(r"^S\d+$"))
    own, added = program.filter(~inserted), program.filter(inserted)
    known = blocks.select(*ident)
    known = known if gaps is None else known.unionByName(gaps.select(*ident))
    missing = problem(blocks.join(own, ident, "left_anti"), "missing")
    extra = problem(own.join(known, ident, "left_anti"), "extra")
    kind = F.coalesce("kind", F.lit("speech")) if "kind" in blocks.columns else F.lit("speech")
    both = own.join(blocks.select(*ident, "text", kind.alias("kind")), ident)
    if gaps is not None:
        both = both.join(gaps.select(*ident), ident, "left_anti")
    out = missing.unionByName(extra)
    if inserts is None:
        out = out.unionByName(problem(added, "extra"))
    else:
        out = out.unionByName(problem(added.join(inserts, ident, "left_anti"), "extra"))
        spoken = added.join(inserts.select(*ident, "text"), ident).withColumn("kind", F.lit("insert"))
        both = both.unionByName(spoken)
    marked = F.contains(F.col("raw"), F.lit("~~")) & (~F.contains(F.col("text"), F.lit("~~")) | (F.col("kind") == "insert"))
    clean = F.when(marked, tx.parse_strikes(F.col("raw"))["clean"]).otherwise(F.col("raw"))
    altered = problem(both.filter(tx.no_space(clean) != tx.no_space(F.col("text"))), "altered")
    wanted = both.filter("keep AND kind = 'speech'").select(*ident, tx.no_space(F.col("text")).alias("flat")).distinct()
    return out.unionByName(altered).unionByName(problem(not_in_transcript(wanted, cues, by, ident), "not_in_transcript"))


def apply_marks(
    program: DataFrame,
    track_blocks: DataFrame,
    gaps: DataFrame,
    by: str | Sequence[str] = "session_id",
) -> DataFrame:
    """Ticks of the plan on track blocks and gap rows.

    A block that is not in the plan is dropped; a gap row without a tick is off.
    """
    by = as_list(by)
    marks = program.groupBy(*by, "block_id").agg(F.max_by("keep", "seq").alias("keep"))
    kept = track_blocks.join(marks, [*by, "block_id"]).select(
        *by, F.lit("block").alias("kind"), "block_id", "start_ms", "end_ms", "keep"
    )
    silent = (
        gaps.withColumnRenamed("gap_id", "block_id")
        .join(marks, [*by, "block_id"], "left")
        .select(
            *by,
            F.lit("gap").alias("kind"),
            "block_id",
            "start_ms",
            "end_ms",
            F.coalesce("keep", F.lit(False)).alias("keep"),
        )
    )
    return kept.unionByName(silent)
