"""Caption files to cue tables and back.

Readers take whole files (one recording each); the ``parse_*`` functions do the
same for a table that already holds the texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.functions import text as tx
from cueline.functions.clock import ms_to_srt, srt_to_ms
from cueline.operators.scan import (
    as_list,
    nearest_value,
    row_chunk,
    running_sum,
    scan,
    with_neighbours,
    with_position,
)

SPEAKER = r"^\[([^\]]{1,20})\]\s*"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(session_id, content)`` of the files under ``path``; the id is the file name."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(
        name.alias("session_id"), F.col("value").alias("content")
    )


def parse_srt(texts: DataFrame, by: str | Sequence[str] = "session_id") -> DataFrame:
    """Cues of SRT texts: ``idx, start_ms, end_ms, text, speaker``.

    Blocks are divided by blank lines; the number line may be missing; a
    ``[name]`` of up to 20 characters in front of the text is the speaker.
    Blocks without a time line are passed over and not counted.
    """
    by = as_list(by)
    content = tx.strip(F.regexp_replace(F.regexp_replace("content", "\r\n?", "\n"), "^﻿", ""))
    blocks = texts.select(*by, F.posexplode(F.split(content, "\n\n")).alias("block", "body"))
    lines = F.filter(F.split("body", "\n"), lambda line: tx.strip(line) != "")
    listed = blocks.select(*by, "block", lines.alias("lines"))
    second = F.contains(F.get("lines", 1), F.lit("-->"))
    first = F.contains(F.get("lines", 0), F.lit("-->"))
    at = F.when(F.coalesce(second, F.lit(False)), 1).when(F.coalesce(first, F.lit(False)), 0)
    found = listed.withColumn("at", at).filter("at IS NOT NULL")
    times = F.split(F.get("lines", F.col("at")), "-->")
    body = tx.strip(F.array_join(F.slice("lines", F.col("at") + 2, F.size("lines")), "\n"))
    parsed = found.select(
        *by, "block", srt_to_ms(F.get(times, 0)).alias("start_ms"), srt_to_ms(F.get(times, 1)).alias("end_ms"), body.alias("body")
    )
    numbered = with_position(parsed, by, ["block"], row_chunk("block"), "idx")
    speaker = F.regexp_extract("body", tx.pattern(SPEAKER), 1)
    return numbered.select(
        *by,
        "idx",
        "start_ms",
        "end_ms",
        F.regexp_replace("body", tx.pattern(SPEAKER), "").alias("text"),
        F.when(speaker != "", speaker).alias("speaker"),
    )


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    return parse_srt(read_texts(spark, path))


def srt_block(no: Column, start: Column, end: Column, text: Column, speaker: Column) -> Column:
    """One block of an SRT file, without the blank line after it."""
    name = F.when(speaker.isNotNull() & (speaker != ""), F.concat(F.lit("["), speaker, F.lit("] ")))
    return F.concat(
        no.cast("string"),
        F.lit("\n"),
        ms_to_srt(start),
        F.lit(" --> "),
        ms_to_srt(end),
        F.lit("\n"),
        F.coalesce(name, F.lit("")),
        text,
        F.lit("\n"),
    )


def render_srt(
    cues: DataFrame, by: str | Sequence[str] = "session_id", order: Sequence[str] = ("idx",)
) -> DataFrame:
    """Renumbered SRT blocks, one row each: ``(no, block)``."""
    by = as_list(by)
    numbered = with_position(cues, by, order, row_chunk(order[0]), "no")
    c = F.col
    return numbered.select(
        *by, "no", srt_block(c("no"), c("start_ms"), c("end_ms"), c("text"), c("speaker")).alias("block")
    )


def write_lines(df: DataFrame, path: str, by: str = "session_id", order: str = "no", line: str = "line") -> None:
    """Ordered text files, one folder per session.

    Rows are range-partitioned by session and order, so a long session becomes
    several part files whose names follow the order.
    """
    (
        df.select(by, order, line)
        .repartitionByRange(by, order)
        .sortWithinPartitions(by, order)
        .select(by, F.col(line).alias("value"))
        .write.partitionBy(by)
        .mode("errorifexists")
        .text(path)
    )


def write_srt(cues: DataFrame, path: str, by: str = "session_id", order: str = "idx") -> None:
    write_lines(render_srt(cues, by, [order]), path, by, "no", "block")


def parse_vtt(texts: DataFrame, by: str | Sequence[str] = "session_id") -> DataFrame:
    """Lines of rolling captions without their repeats: ``(line_no, clock, text)``.

    When some lines of a cue carry timing tags only those count.  Tags are
    removed, and a line equal to the line before it is dropped.
    """
    by = as_list(by)
    content = F.regexp_replace("content", "\r\n?", "\n")
    lines = texts.select(*by, F.posexplode(F.split(content, "\n")).alias("line_no", "line"))
    clock = F.regexp_extract(tx.strip(F.col("line")), r"^(\d{2}:\d{2}:\d{2})\.\d{3}\s+-->", 1)
    stamped = lines.withColumn("clock", F.when(clock != "", clock))
    chunk = row_chunk("line_no")
    cued = scan(
        stamped,
        by,
        ["line_no"],
        chunk,
        cue=running_sum(F.col("clock").isNotNull().cast("int")),
        at=nearest_value(F.col("clock"), inclusive=True),
    )
    skipped = tx.has_prefix(F.col("line"), ["WEBVTT", "Kind:", "Language:"]) | (
        tx.strip(F.col("line")) == ""
    )
    body = cued.filter(F.col("clock").isNull() & F.col("at").isNotNull() & ~skipped)
    tagged = F.contains("line", F.lit("<c>")) | F.regexp_like("line", F.lit(r"<\d"))
    marked = body.withColumn("tagged", tagged)
    any_tagged = marked.groupBy(*by, "cue").agg(F.bool_or("tagged").alias("any_tagged"))
    text = tx.strip(F.regexp_replace("line", r"<[^>]+>", ""))
    picked = (
        marked.join(any_tagged, [*by, "cue"])
        .filter(F.col("tagged") | ~F.col("any_tagged"))
        .select(*by, "line_no", F.col("at").alias("clock"), text.alias("text"))
        .filter("text <> ''")
    )
    lagged = with_neighbours(picked, by, ["line_no"], chunk, previous={"prev_text": "text"})
    return lagged.filter("prev_text IS NULL OR prev_text <> text").drop("prev_text")


def read_vtt(spark: SparkSession, path: str) -> DataFrame:
    return parse_vtt(read_texts(spark, path))


WORDS = "array<struct<start:double,end:double,word:string>>"


def parse_words(
    texts: DataFrame, by: str | Sequence[str] = "session_id", max_word_ms: int = 3000
) -> DataFrame:
    """Words of JSON arrays; longer ones are artefacts of the recogniser."""
    by = as_list(by)
    words = texts.select(*by, F.posexplode(F.from_json("content", WORDS)).alias("pos", "w"))
    timed = words.select(
        *by,
        F.col("pos").cast("bigint").alias("pos"),
        F.round(F.col("w.start") * 1000).cast("bigint").alias("start_ms"),
        F.round(F.col("w.end") * 1000).cast("bigint").alias("end_ms"),
        F.col("w.word").alias("word"),
    )
    return timed.filter(F.col("end_ms") - F.col("start_ms") <= max_word_ms)


def read_words(spark: SparkSession, path: str, max_word_ms: int = 3000) -> DataFrame:
    return parse_words(read_texts(spark, path), max_word_ms=max_word_ms)


PROSODY = (
    "struct<silences:array<struct<start:double,end:double>>,segments:array<struct<"
    "idx:bigint,start:double,end:double,speaker:string,text:string,rms_db:double,f0_p75:double,"
    "f0_range:double,rate:double,voiced_ratio:double,excitement:double>>>"
)


def parse_prosody(
    texts: DataFrame, by: str | Sequence[str] = "session_id"
) -> tuple[DataFrame, DataFrame]:
    """``(silences, segments)`` of prosody files; not-a-number becomes null."""
    by = as_list(by)
    # the files write NaN where JSON has no number
    content = F.regexp_replace("content", r":\s*NaN", ": null")
    rows = texts.select(*by, F.from_json(content, PROSODY).alias("p"))

    def ms(column: str) -> Column:
        return F.round(F.col(column) * 1000).cast("bigint")

    silences = rows.select(*by, F.explode("p.silences").alias("s")).select(
        *by, ms("s.start").alias("start_ms"), ms("s.end").alias("end_ms")
    )
    segments = rows.select(*by, F.explode("p.segments").alias("s")).select(
        *by,
        F.col("s.idx").alias("idx"),
        ms("s.start").alias("start_ms"),
        ms("s.end").alias("end_ms"),
        *[
            F.col(f"s.{c}").alias(c)
            for c in ("speaker", "text", "rms_db", "f0_p75", "f0_range", "rate", "voiced_ratio", "excitement")
        ],
    )
    return silences, segments


def read_prosody(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_prosody(read_texts(spark, path))


def read_document_pages(pages: DataFrame, by: Sequence[str] = ("doc_id", "page")) -> DataFrame:
    """Lines of page texts: ``(line_no, line)``."""
    by = list(by)
    return pages.select(*by, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
