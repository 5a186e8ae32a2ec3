"""Transcript cleaning and document text quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueline.functions import constants as k
from cueline.functions import text as tx
from cueline.operators.scan import (
    CHUNK_ROWS,
    as_list,
    nearest_value,
    row_chunk,
    running_count,
    running_sum,
    scan,
    with_position,
)
from cueline.session import settle


def dict_overlay(base: DataFrame, domain: DataFrame) -> DataFrame:
    """Union of two dictionaries ``(ord, wrong, right)``; the domain wins.

    Base order is kept and new entries follow it.
    """
    b = base.select("wrong", F.col("ord").alias("b_ord"), F.col("right").alias("b_right"))
    d = domain.select("wrong", F.col("ord").alias("d_ord"), F.col("right").alias("d_right"))
    return b.join(d, "wrong", "full_outer").select(
        "wrong",
        F.coalesce("d_right", "b_right").alias("right"),
        F.when(F.col("b_ord").isNotNull(), 0).otherwise(1).alias("part"),
        F.coalesce("b_ord", "d_ord").alias("ord"),
    )


def clean_segments(
    df: DataFrame,
    dictionary: Sequence[tuple[str, str]] = tuple(k.BASE_CORRECTIONS),
    drop_prefixes: Sequence[str] = tuple(k.DROP_PREFIXES),
    strip_prefixes: Sequence[str] = tuple(k.STRIP_PREFIXES),
    text: str = "text",
) -> DataFrame:
    """One projection that decides every segment.

    Adds ``clean``, ``drop_reason`` (null when the segment stays), ``hits`` and
    ``stripped``.  The order of the rules decides the reason: corrections,
    empty, prefix, wrapper, short, garbled.
    """
    squeezed = tx.squeeze_spaces(F.col(text))
    fixed = df.withColumn("__f", tx.apply_dictionary(squeezed, tx.pairs_array(dictionary)))
    base = F.col("__f.text")
    early = F.when(base == "", "empty").when(tx.has_prefix(base, drop_prefixes), "hallucination")
    wrapped = early.isNull() & tx.has_prefix(base, strip_prefixes)
    staged = (
        fixed.withColumn("__early", early)
        .withColumn("hits", F.col("__f.hits"))
        .withColumn("stripped", wrapped)
        .withColumn("clean", tx.strip_wrapper_prefix(base, strip_prefixes))
    )
    reason = (
        F.when(F.col("__early").isNotNull(), F.col("__early"))
        .when(tx.is_short(F.col("clean")), "empty")
        .when(tx.is_garbled(F.col("clean")), "garbled")
    )
    return staged.withColumn("drop_reason", reason).drop("__f", "__early")


def clean_stats(cleaned: DataFrame, by: str | Sequence[str] = "session_id") -> DataFrame:
    reason = F.col("drop_reason")
    return cleaned.groupBy(*as_list(by)).agg(
        F.count("*").alias("original"),
        F.count_if(reason == "empty").alias("dropped_empty"),
        F.count_if(reason == "hallucination").alias("dropped_hallucination"),
        F.count_if(reason == "garbled").alias("dropped_garbled"),
        F.sum("hits").alias("typo_hits"),
        F.count_if(F.col("stripped")).alias("wrapper_stripped"),
        F.count_if(reason.isNull()).alias("surviving"),
    )


def hallucination_filter(df: DataFrame, lang: str, text: str = "text") -> DataFrame:
    """Rows that are speech under the rules of one language."""
    column = F.col(text)
    bad = {
        "en": tx.is_english_hallucination,
        "it": tx.is_italian_hallucination,
        "it_batch": tx.is_batch_dropped,
        "ja": lambda c: tx.strip(c) == "",
        "zh_notes": lambda c: tx.is_notes_noise(c, "zh"),
        "en_notes": lambda c: tx.is_notes_noise(c, "en"),
    }[lang](column)
    return df.filter(~bad)


def clean_batch(df: DataFrame, corrections: Sequence[tuple[str, str]], text: str = "text") -> DataFrame:
    """The batch form of cleaning: drop hallucinated and garbled rows, correct spellings, strip marker emoji."""
    kept = df.filter(~tx.is_batch_dropped(F.col(text)))
    fixed = F.col(text)
    for wrong, right in corrections:
        fixed = F.replace(fixed, F.lit(wrong), F.lit(right))
    return kept.withColumn(text, tx.strip_marker_emoji(fixed))


def _repeated_phrase(t: Column, size: int) -> Column:
    """The first phrase of ``size`` characters, not all blank, said often enough in a row: (gram, n) or null."""
    again = rf"(?sU)(?=\s{{0,{size - 1}}}\S)(.{{{size}}})\1{{{k.PHRASE_REPEATS - 1},}}"

    def found(whole: Column) -> Column:
        return F.when(whole != "", F.struct(F.substring(whole, 1, size).alias("gram"), (F.length(whole) / size).cast("int").alias("n")))

    return tx.bound(F.regexp_extract(t, again, 0), found)


def _filled(template: str, **values: Column) -> Column:
    """A message with its ``{name}`` marks replaced by columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def repeat_loop_reason(text: Column) -> Column:
    """Why a text looks like a recogniser loop, or null.

    Back-references do the matching: the longest run of one character, else very few different characters, else
    the shortest phrase that is repeated, each at its leftmost place.
    """
    run = rf"(?s)(.)\1{{{k.RUN_MIN - 1},}}"
    words = k.ARTIFACT_TEXT

    def said_again(phrase: Column) -> Column:
        return F.when(phrase.isNotNull(), _filled(words["phrase"], n=phrase["n"], gram=phrase["gram"]))

    def few_or_again(t: Column, kinds: Column) -> Column:
        few = (F.length(t) >= k.FEW_CHARS_LEN) & (kinds <= k.FEW_CHARS_MAX)
        phrase = F.coalesce(*[_repeated_phrase(t, size) for size in k.PHRASE_LENGTHS])
        return F.when(few, _filled(words["few"], k=kinds, n=F.length(t))).otherwise(tx.bound(phrase, said_again))

    def judged(t: Column, runs: Column) -> Column:
        kinds = F.size(F.array_distinct(F.split(t, "")))
        return (
            F.when(F.contains(t, F.lit(k.REPLACEMENT_CHAR)), F.lit(words["replacement"]))
            .when(F.size(runs) > 0, _filled(words["run"], n=F.array_max(runs)))
            .otherwise(tx.bound(kinds, lambda n: few_or_again(t, n)))
        )

    def lengths(t: Column) -> Column:
        return F.transform(F.regexp_extract_all(t, F.lit(run), F.lit(0)), lambda r: F.length(r))

    return tx.bound(tx.strip(text), lambda t: tx.bound(lengths(t), lambda runs: judged(t, runs)))


def flag_artifacts(df: DataFrame, text: str = "text", overwrite: bool = True) -> DataFrame:
    """Mark loops in ``asr_artifact`` / ``asr_artifact_reason``; never drop.

    An existing ``reason`` stays.  With ``overwrite`` false only rows whose
    ``asr_artifact`` is null are judged.
    """
    found = df.withColumn("__r", repeat_loop_reason(F.col(text)))
    flag = F.col("__r").isNotNull()
    why = F.coalesce("__r", F.lit(""))
    if not overwrite and "asr_artifact" in df.columns:
        judged = F.col("asr_artifact").isNotNull()
        flag = F.coalesce("asr_artifact", flag)
        why = F.when(judged, F.col("asr_artifact_reason")).otherwise(why)
    marked = found.withColumn("asr_artifact_reason", why).withColumn("asr_artifact", flag)
    if overwrite and "reason" in df.columns:
        empty = F.coalesce("reason", F.lit("")) == ""
        note = F.concat(F.lit(k.ARTIFACT_TEXT["mark"]), F.col("__r"))
        marked = marked.withColumn(
            "reason", F.when(empty & F.col("__r").isNotNull(), note).otherwise(F.col("reason"))
        )
    return marked.drop("__r")


def fence_state(
    lines: DataFrame,
    by: str | Sequence[str] = "doc_id",
    line: str = "line",
    line_no: str = "line_no",
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Adds ``is_fence`` and ``in_fence`` (inside a fenced code block)."""
    mark = F.startswith(F.ltrim(F.col(line)), F.lit("```"))
    out = scan(
        lines.withColumn("is_fence", mark),
        by,
        [line_no],
        row_chunk(line_no, rows),
        __fences=running_sum(F.col("is_fence").cast("int")),
    )
    return out.withColumn("in_fence", F.col("__fences") % 2 == 1).drop("__fences")


def normalize_width(
    lines: DataFrame,
    by: str | Sequence[str] = "doc_id",
    line: str = "line",
    line_no: str = "line_no",
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Full-width punctuation outside code fences; adds ``changes`` per line."""
    fenced = fence_state(lines, by, line, line_no, rows)
    skip = F.col("in_fence") | F.col("is_fence")
    done = fenced.withColumn("__n", tx.normalize_width_line(F.col(line)))
    return (
        done.withColumn(line, F.when(skip, F.col(line)).otherwise(F.col("__n.line")))
        .withColumn("changes", F.when(skip, F.lit(0)).otherwise(F.col("__n.changes")))
        .drop("__n", "is_fence", "in_fence")
    )


def residual_halfwidth(lines: DataFrame, by: str | Sequence[str] = "doc_id", **names) -> DataFrame:
    """Marks still to convert per document; 0 means clean."""
    return (
        normalize_width(lines, by, **names)
        .groupBy(*as_list(by))
        .agg(F.sum("changes").cast("bigint").alias("residual"))
    )


def drop_screen_noise(
    boxes: DataFrame, by: str | Sequence[str] = "frame_id", crop: dict | None = None
) -> DataFrame:
    """Text boxes of screen frames without desktop noise and repeats.

    ``boxes`` has ``pos, x, y, text``.  A frame that is mostly noise keeps only
    its central area.  Boxes alike in their first 10 visible characters are
    reduced to the first.
    """
    by = as_list(by)
    crop = crop or k.SCREEN_CROP
    # read for the rates and for the boxes, so the rules are tried once and their outcome kept
    judged = settle(boxes.withColumn("noise", tx.is_screen_noise(F.col("text"))), 0)
    rate = judged.groupBy(*by).agg(F.avg(F.col("noise").cast("double")).alias("__rate"))
    central = F.col("x").between(*crop["x"]) & F.col("y").between(*crop["y"])
    kept = (
        judged.filter(~F.col("noise"))
        .join(rate, by)
        .filter((F.col("__rate") < crop["ratio"]) | central)
    )
    head = F.substring(tx.no_space(F.col("text")), 1, 10)
    return (
        kept.groupBy(*by, head.alias("__key"))
        .agg(F.min(F.struct("pos", "x", "y", "text")).alias("b"))
        .select(*by, "b.*")
    )


def split_sections(
    lines: DataFrame, by: str | Sequence[str] = "doc_id", rows: int = CHUNK_ROWS
) -> DataFrame:
    """Markdown lines with their chapter number and title.

    Chapter 0 is the text before the first ``## `` heading.  Headings and blank
    lines themselves are left out.
    """
    by = as_list(by)
    head = F.startswith("line", F.lit("## "))
    title = F.when(head, tx.strip(F.substring("line", 4, 2**31 - 1)))
    out = scan(
        lines,
        by,
        ["line_no"],
        row_chunk("line_no", rows),
        chapter=running_sum(head.cast("int")),
        title=nearest_value(title, inclusive=True),
    )
    text = F.regexp_replace("line", tx.pattern(r"\s+$"), "")
    top = F.startswith("line", F.lit("# "))
    return out.filter(~head & ~top & (tx.strip(F.col("line")) != "")).select(
        *by, "line_no", "chapter", F.coalesce("title", F.lit("")).alias("title"), text.alias("line")
    )


def publish_lines(
    lines: DataFrame,
    by: str | Sequence[str] = "doc_id",
    agenda: str = k.AGENDA_HEADING,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Lines to publish: no agenda section, rules or talk lines; ``####`` demoted."""
    by = as_list(by)
    head = F.startswith("line", F.lit("## "))
    is_agenda = F.when(head, F.startswith("line", F.lit(agenda)))
    state = scan(
        lines,
        by,
        ["line_no"],
        row_chunk("line_no", rows),
        agenda=nearest_value(is_agenda, inclusive=True),
    )
    t = tx.strip(F.col("line"))
    keep = (
        ~F.coalesce("agenda", F.lit(False)) & (t != "---") & ~tx.has_prefix(F.col("line"), k.TALK_LINES)
    )
    demoted = F.when(
        F.startswith("line", F.lit("#### ")), F.substring("line", 2, 2**31 - 1)
    ).otherwise(F.col("line"))
    return state.filter(keep).select(*by, "line_no", demoted.alias("line"))


def edge_lines(
    lines: DataFrame, by: Sequence[str] = ("doc_id", "page"), edge: int = 3
) -> DataFrame:
    """How often each line stands among the first or last lines of a page."""
    by = list(by)
    visible = lines.withColumn("line", tx.strip(F.col("line"))).filter("line <> ''")
    placed = scan(
        visible,
        by,
        ["line_no"],
        row_chunk("line_no"),
        top=running_count(),
        bottom=running_count(reverse=True),
    )
    times = (F.col("top") <= edge).cast("int") + (F.col("bottom") <= edge).cast("int")
    return placed.filter(times > 0).groupBy(by[0], "line").agg(
        F.sum(times).cast("bigint").alias("times")
    )


def repeated_lines(
    lines: DataFrame,
    by: Sequence[str] = ("doc_id", "page"),
    edge: int = 3,
    ratio: float = 0.5,
    min_pages: int = 4,
) -> DataFrame:
    """Running heads and feet: lines on at least ``ratio`` of a document's pages."""
    doc = by[0]
    pages = lines.groupBy(doc).agg(F.count_distinct(by[1]).alias("pages"))
    least = F.greatest(F.lit(3.0), F.col("pages") * ratio)
    return (
        edge_lines(lines, by, edge)
        .join(pages, doc)
        .filter((F.col("pages") >= min_pages) & (F.length("line") > 3) & (F.col("times") >= least))
        .select(doc, "line", "times")
    )


def strip_repeated_lines(
    lines: DataFrame, repeated: DataFrame, by: Sequence[str] = ("doc_id", "page")
) -> DataFrame:
    marks = repeated.select(by[0], F.col("line").alias("__line")).distinct()
    return (
        lines.withColumn("__line", tx.strip(F.col("line")))
        .join(marks, [by[0], "__line"], "left_anti")
        .drop("__line")
    )


def majority_vote(df: DataFrame, predicate: Column, by: str | Sequence[str], name: str) -> DataFrame:
    """True where more than half of a group's rows satisfy ``predicate``."""
    return df.groupBy(*as_list(by)).agg((F.avg(predicate.cast("double")) > 0.5).alias(name))


def validate_notes(df: DataFrame, required: Sequence[str] = tuple(k.NOTE_FIELDS)) -> DataFrame:
    """Names of required fields that are null or empty."""

    def absent(name: str) -> Column:
        column = F.col(name)
        kind = dict(df.dtypes)[name]
        if kind.startswith("array"):
            return column.isNull() | (F.size(column) == 0)
        return column.isNull() | (column.cast("string") == "")

    marks = F.array(*[F.when(absent(n), F.lit(n)) for n in required])
    return df.withColumn("missing", F.filter(marks, lambda m: m.isNotNull()))


def track_prefix(tracks: DataFrame, by: str | Sequence[str] = "session_id") -> DataFrame:
    """Two-letter code per track name, numbered fallback on collision.

    ``tracks`` has ``track_no`` and ``track``: a handful of names per session after ``distinct``.  The codes given so
    far are the state of a fold over them.
    """
    by = as_list(by)
    names = tracks.groupBy(*by, "track").agg(F.min("track_no").alias("track_no"))
    listed = names.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("track_no", "track"))).alias("ts"))

    def initials(name: Column) -> Column:
        letters = F.regexp_replace(F.upper(name), "[^A-Z]", "")
        rest = F.substring(letters, 2, 2**31 - 1)
        second = F.left(F.concat(F.regexp_replace(rest, "[AEIOU]", ""), rest), F.lit(1))
        return F.when(F.length(rest) > 0, F.concat(F.left(letters, F.lit(1)), second))

    def given(codes: Column, track: Column) -> Column:
        place = F.size(codes) + 1
        numbered = F.transform(
            F.sequence(F.lit(0), place),
            lambda n: F.concat(F.lit("T"), place.cast("string"), F.when(n > 0, n.cast("string")).otherwise("")),
        )
        free = F.filter(F.concat(F.array(initials(track["track"])), numbered), lambda c: c.isNotNull() & ~F.array_contains(codes, c))
        return F.concat(codes, F.array(F.get(free, F.lit(0))))

    codes = F.aggregate("ts", F.array().cast("array<string>"), given)
    return listed.select(*by, F.explode(F.arrays_zip("ts", codes.alias("code"))).alias("x")).select(
        *by, F.col("x.ts.track").alias("track"), F.col("x.code").alias("prefix")
    )
