"""Edit plan files: ordered lines to plan rows and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.functions import text as tx
from cueline.functions.clock import clock_to_ms, ms_to_clock
from cueline.operators.scan import as_list, nearest_value, row_chunk, scan
from cueline.sources.captions import read_texts, write_lines

# fixed values: the line forms of a plan file
CONFIG = r"^##\s*⚙️?\s*(.*)$"
MUSIC = r"^##\s*🎵\s*(\S+)((?:\s+\w+=[\d.]+)*)\s*$"
INSERT = r"^##\s*➕\s*(\S+)((?:\s+\w+=[\w.+-]+)*)\s*(.*)$"
CUT = r"^##\s*✂\s*([\d:.]+)\s*[-–~]\s*([\d:.]+)\s*(.*)$"
TEASER = r"^##\s*🎬\s*(.*)$"
CHAPTER = r"^## (.+)$"
ROW = r"^- \[( |x|X)\] ([A-Z]{1,2}\d{3,5}) \[([^\]]+)\] (.*)$"
INSERT_ROW = r"^S\d{3,5}$"
NO_CHAPTER = "## Cutplan"


def _pairs(text: Column, key: str, value: str) -> Column:
    body = f"({key})=({value})"
    return F.map_from_arrays(
        F.regexp_extract_all(text, F.lit(body), 1), F.regexp_extract_all(text, F.lit(body), 2)
    )


def parse_plan(lines: DataFrame, by: str | Sequence[str] = "session_id") -> DataFrame:
    """Plan rows from ordered lines ``(seq, line)``.

    ``kind`` is config, music, insert, cut, chapter or block.  Blocks below a
    teaser heading are clips; rows of an insert belong to the insert above them.
    """
    by = as_list(by)
    s = tx.strip(F.col("line"))
    stripped = lines.select(*by, "seq", s.alias("s"))
    c = F.col("s")

    def is_(form: str) -> Column:
        return F.regexp_like(c, F.lit(form))

    kind = (
        F.when(is_(CONFIG), "config")
        .when(is_(MUSIC), "music")
        .when(is_(INSERT), "insert")
        .when(is_(CUT), "cut")
        .when(is_(TEASER), "teaser")
        .when(is_(CHAPTER) & ~F.startswith(c, F.lit(NO_CHAPTER)), "chapter")
        .when(is_(ROW), "block")
    )
    typed = stripped.withColumn("kind", kind).filter("kind IS NOT NULL")
    clip = F.when(F.col("kind") == "teaser", True).when(
        F.col("kind").isin("music", "insert", "chapter"), False
    )
    insert = F.when(F.col("kind") == "insert", F.regexp_extract(c, INSERT, 1))
    scoped = scan(
        typed,
        by,
        ["seq"],
        row_chunk("seq"),
        __clip=nearest_value(clip, inclusive=True),
        __insert=nearest_value(insert, inclusive=True),
    ).filter("kind <> 'teaser'")
    block_id = F.regexp_extract(c, ROW, 2)
    body = F.regexp_extract(c, ROW, 4)
    # what follows the last arrow is a remark, a bracketed name in front the speaker
    body = F.regexp_replace(body, r"(?s)^(.*) ← .*$", "$1")
    raw = tx.strip(F.regexp_replace(body, tx.pattern(r"^\[[^\]]{1,20}\]\s*"), ""))
    k = F.col("kind")
    params = (
        F.when(k == "config", _pairs(F.regexp_extract(c, CONFIG, 1), r"[\w-]+", r"[\d.]+"))
        .when(k == "music", _pairs(F.regexp_extract(c, MUSIC, 2), r"\w+", r"[\d.]+"))
        .when(k == "insert", _pairs(F.regexp_extract(c, INSERT, 2), r"\w+", r"[\w.+-]+"))
    )
    name = (
        F.when(k == "music", F.regexp_extract(c, MUSIC, 1))
        .when(k == "insert", F.regexp_extract(c, INSERT, 1))
        .when(k == "chapter", tx.strip(F.regexp_extract(c, CHAPTER, 1)))
    )
    note = F.when(k == "cut", tx.strip(F.regexp_extract(c, CUT, 3))).when(
        k == "insert", tx.strip(F.regexp_extract(c, INSERT, 3))
    )
    is_block = k == "block"
    return scoped.select(
        *by,
        "seq",
        "kind",
        F.when(is_block, block_id).alias("block_id"),
        F.when(is_block, F.lower(F.regexp_extract(c, ROW, 1)) == "x").alias("keep"),
        F.when(is_block, raw).alias("raw"),
        F.when(is_block, F.coalesce("__clip", F.lit(False))).alias("clip"),
        F.when(is_block & F.regexp_like(block_id, F.lit(INSERT_ROW)), F.col("__insert")).alias("insert"),
        F.when(k == "cut", clock_to_ms(F.regexp_extract(c, CUT, 1))).alias("a_ms"),
        F.when(k == "cut", clock_to_ms(F.regexp_extract(c, CUT, 2))).alias("b_ms"),
        name.alias("name"),
        note.alias("note"),
        params.alias("params"),
    )


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    texts = read_texts(spark, path)
    lines = texts.select(
        "session_id", F.posexplode(F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n")).alias("seq", "line")
    )
    return parse_plan(lines)


def plan_line(block_id: Column, keep: Column, start: Column, end: Column, speaker: Column, text: Column, reason: Column) -> Column:
    """A block row of a plan file."""
    return F.concat(
        F.lit("- ["),
        F.when(keep, "x").otherwise(" "),
        F.lit("] "),
        block_id,
        F.lit(" ["),
        ms_to_clock(start),
        F.lit("–"),
        ms_to_clock(end),
        F.lit("] "),
        F.when(F.coalesce(speaker, F.lit("")) != "", F.concat(F.lit("["), speaker, F.lit("] "))).otherwise(""),
        text,
        F.when(F.coalesce(reason, F.lit("")) != "", F.concat(F.lit(" ← "), reason)).otherwise(""),
    )


def write_plan(lines: DataFrame, path: str, by: str = "session_id") -> None:
    """Ordered plan lines ``(seq, line)`` as text files, one folder per session."""
    write_lines(lines, path, by, "seq", "line")
