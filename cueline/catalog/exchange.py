"""Source and sink queries: texts are rendered from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueline import fixtures as fx
from cueline.fixtures import with_views
from cueline.session import cut_lineage
from cueline.sources import captions as ca
from cueline.sources import planfiles as pf

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, views: str | None = None, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(views, sql) if views else sql
        return fn

    return register


#: Cues per rendered file; a file never holds a whole long session.
PART = 8
SRT_TIME = "printf('%02d:%02d:%02d,%03d', {0}//3600000, {0}%3600000//60000, {0}%60000//1000, {0}%1000)"
#: One-line, non-empty texts, so that blocks divide cleanly.
ONE_LINE = r"regexp_replace(trim(text), '\s+', ' ', 'g')"


def one_line_cues(spark, sf):
    text = F.regexp_replace(F.trim("text"), r"\s+", " ")
    return fx.cues(spark, sf).withColumn("text", F.trim(text)).filter("text <> ''")


@query(
    "write_srt",
    "cues",
    f"""SELECT session_id, no, no || chr(10) || {SRT_TIME.format('start_ms')} || ' --> ' || {SRT_TIME.format('end_ms')} || chr(10) || '[' || speaker || '] ' || text || chr(10) AS block
        FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS no FROM cues)""",
)
def write_srt(spark, sf):
    return ca.render_srt(fx.cues(spark, sf))


def _files(spark, sf, block):
    """Rendered blocks gathered into files of a few cues each."""
    rows = one_line_cues(spark, sf).withColumn("part", F.floor(F.col("idx") / PART).cast("bigint"))
    listed = F.array_sort(F.collect_list(F.struct("idx", block.alias("b"))))
    return rows.groupBy("session_id", "part").agg(
        F.array_join(F.transform(listed, lambda x: x["b"]), "\n").alias("content")
    )


@query(
    "read_srt",
    "cues",
    f"""SELECT session_id, idx // {PART} AS part, row_number() OVER (PARTITION BY session_id, idx // {PART} ORDER BY idx) AS idx,
        start_ms, end_ms, speaker, trim({ONE_LINE}) AS text FROM cues WHERE trim({ONE_LINE}) <> ''""",
)
def read_srt(spark, sf):
    c = F.col
    block = ca.srt_block(c("idx"), c("start_ms"), c("end_ms"), c("text"), c("speaker"))
    # some files have no number lines, some have bytes of another system
    bare = F.regexp_replace(block, r"^\d+\n", "")
    shown = F.when(c("idx") % 3 == 0, bare).when(c("idx") % 3 == 1, F.replace(block, F.lit("\n"), F.lit("\r\n"))).otherwise(block)
    return ca.parse_srt(_files(spark, sf, shown), ["session_id", "part"])


@query(
    "read_vtt",
    "cues",
    f"""WITH c AS (SELECT session_id, idx // {PART} AS part, idx, start_ms, trim({ONE_LINE}) AS text FROM cues WHERE trim({ONE_LINE}) <> ''),
    l AS (SELECT session_id, part, idx, 0 AS k, start_ms, lag(text) OVER (PARTITION BY session_id, part ORDER BY idx) AS text FROM c WHERE FALSE
      UNION ALL SELECT session_id, part, idx, 1, start_ms, text FROM c),
    d AS (SELECT *, lag(text) OVER (PARTITION BY session_id, part ORDER BY idx, k) AS prev FROM l)
    SELECT session_id, part, printf('%02d:%02d:%02d', start_ms//3600000, start_ms%3600000//60000, start_ms%60000//1000) AS clock, text
    FROM d WHERE prev IS NULL OR prev <> text""",
)
def read_vtt(spark, sf):
    """Rolling captions: every cue shows the last line again above the tagged new one."""
    from cueline.functions.clock import ms_to_srt

    stamp = F.replace(ms_to_srt(F.col("start_ms")), F.lit(","), F.lit("."))
    block = F.concat(
        F.when(F.col("idx") % PART == 0, "WEBVTT\nKind: captions\n\n").otherwise(""),
        stamp,
        F.lit(" --> 00:00:00.000 align:start\nshown before\n<c>"),
        F.col("text"),
        F.lit("</c>\n"),
    )
    return ca.parse_vtt(_files(spark, sf, block), ["session_id", "part"]).select(
        "session_id", "part", "clock", "text"
    )


@query(
    "read_words",
    "words",
    "SELECT session_id, idx, pos, start_ms, start_ms + length(word) * 400 AS end_ms, word FROM words WHERE length(word) * 400 <= 3000",
)
def read_words(spark, sf):
    entry = F.struct(
        "pos",
        F.struct(
            (F.col("start_ms") / 1000.0).alias("start"),
            ((F.col("start_ms") + F.length("word") * 400) / 1000.0).alias("end"),
            "word",
        ).alias("w"),
    )
    texts = (
        fx.words(spark, sf)
        .groupBy("session_id", "idx")
        .agg(F.to_json(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["w"])).alias("content"))
    )
    return ca.parse_words(texts, ["session_id", "idx"])


@query(
    "read_prosody",
    "cues",
    "SELECT session_id, idx, start_ms, end_ms, speaker, CASE WHEN idx % 2 = 0 THEN idx * 1.5 END::DOUBLE AS rms_db FROM cues",
)
def read_prosody(spark, sf):
    rms = F.when(F.col("idx") % 2 == 0, (F.col("idx") * 1.5).cast("string")).otherwise("NaN")
    content = F.concat(
        F.lit('{"silences": [], "segments": [{"idx": '),
        F.col("idx").cast("string"),
        F.lit(', "start": '),
        (F.col("start_ms") / 1000.0).cast("string"),
        F.lit(', "end": '),
        (F.col("end_ms") / 1000.0).cast("string"),
        F.lit(', "speaker": "'),
        F.col("speaker"),
        F.lit('", "rms_db": '),
        rms,
        F.lit("}]}"),
    )
    texts = fx.cues(spark, sf).select("session_id", F.col("idx").alias("part"), content.alias("content"))
    _silences, segments = ca.parse_prosody(texts, ["session_id", "part"])
    return segments.select("session_id", "idx", "start_ms", "end_ms", "speaker", "rms_db")


@query(
    "read_document_pages",
    "doc_lines",
    "SELECT doc_id, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars, CAST(max(line_no) AS INT) AS last_line FROM doc_lines GROUP BY doc_id",
)
def read_document_pages(spark, sf):
    pages = fx.table(spark, sf, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    lines = ca.read_document_pages(pages)
    return lines.groupBy("doc_id").agg(
        F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"), F.max("line_no").alias("last_line")
    )


def plan_lines(spark, sf):
    i = F.col("idx")
    block = pf.plan_line(
        F.when(i % 9 == 4, F.format_string("S%04d", i)).otherwise(F.format_string("B%04d", i)),
        i % 3 != 0,
        F.col("start_ms"),
        F.col("end_ms"),
        F.col("speaker"),
        F.col("text"),
        F.when(i % 4 == 0, "a remark"),
    )
    line = (
        F.when(i % 20 == 0, "## ⚙ clip-gap=0.5 max-pause=0.9")
        .when(i % 7 == 1, "## 🎬 teaser")
        .when(i % 7 == 3, "## 🎵 opening fadein=1.5 lead=2")
        .when(i % 9 == 3, F.format_string("## ➕ take%d.wav gain=auto tempo=1.06 a note", i))
        .when(i % 10 == 9, "## ✂ 1:02.5-70.25 breath")
        .when(i % 11 == 6, F.concat(F.lit("## Chapter "), i.cast("string")))
        .otherwise(block)
    )
    return one_line_cues(spark, sf).select("session_id", i.alias("seq"), line.alias("line"))


CLOCK = "CASE WHEN {0} >= 3600000 THEN printf('%d:%02d:%02d', {0}//3600000, {0}%3600000//60000, {0}%60000//1000) ELSE printf('%d:%02d', {0}//60000, {0}%60000//1000) END"


@query(
    "write_plan",
    "cues",
    f"""SELECT session_id, idx AS seq, '- [' || CASE WHEN idx % 3 <> 0 THEN 'x' ELSE ' ' END || '] ' || printf('B%04d', idx) || ' [' || {CLOCK.format('start_ms')} || '–' || {CLOCK.format('end_ms')} || '] ['
        || speaker || '] ' || text || CASE WHEN idx % 4 = 0 THEN ' ← a remark' ELSE '' END AS line FROM cues""",
)
def write_plan(spark, sf):
    i = F.col("idx")
    line = pf.plan_line(
        F.format_string("B%04d", i), i % 3 != 0, F.col("start_ms"), F.col("end_ms"), F.col("speaker"), F.col("text"), F.when(i % 4 == 0, "a remark")
    )
    return fx.cues(spark, sf).select("session_id", i.alias("seq"), line.alias("line"))


@query(
    "read_plan",
    "cues",
    f"""WITH c AS (SELECT session_id, idx AS seq, trim({ONE_LINE}) AS text FROM cues WHERE trim({ONE_LINE}) <> ''),
    k AS (SELECT *, CASE WHEN seq % 20 = 0 THEN 'config' WHEN seq % 7 = 1 THEN 'teaser' WHEN seq % 7 = 3 THEN 'music' WHEN seq % 9 = 3 THEN 'insert'
            WHEN seq % 10 = 9 THEN 'cut' WHEN seq % 11 = 6 THEN 'chapter' ELSE 'block' END AS kind FROM c),
    s AS (SELECT *, last_value(CASE WHEN kind = 'teaser' THEN TRUE WHEN kind IN ('music', 'insert', 'chapter') THEN FALSE END IGNORE NULLS) OVER w AS cl,
            last_value(CASE WHEN kind = 'insert' THEN 'take' || seq || '.wav' END IGNORE NULLS) OVER w AS ins FROM k WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING))
    SELECT session_id, seq, kind, CASE WHEN kind = 'block' THEN CASE WHEN seq % 9 = 4 THEN printf('S%04d', seq) ELSE printf('B%04d', seq) END END AS block_id,
      CASE WHEN kind = 'block' THEN seq % 3 <> 0 END AS keep, CASE WHEN kind = 'block' THEN text END AS raw, CASE WHEN kind = 'block' THEN coalesce(cl, FALSE) END AS clip,
      CASE WHEN kind = 'block' AND seq % 9 = 4 THEN ins END AS insert, CASE WHEN kind = 'cut' THEN 62500 END::BIGINT AS a_ms, CASE WHEN kind = 'cut' THEN 70250 END::BIGINT AS b_ms,
      CASE kind WHEN 'music' THEN 'opening' WHEN 'insert' THEN 'take' || seq || '.wav' WHEN 'chapter' THEN 'Chapter ' || seq END AS name,
      CASE kind WHEN 'cut' THEN 'breath' WHEN 'insert' THEN 'a note' END AS note,
      CASE kind WHEN 'config' THEN 'clip-gap=0.5 max-pause=0.9' WHEN 'music' THEN 'fadein=1.5 lead=2' WHEN 'insert' THEN 'gain=auto tempo=1.06' END AS params FROM s WHERE kind <> 'teaser'""",
)
def read_plan(spark, sf):
    # the lines are written once, as a plan file would be
    rows = pf.parse_plan(cut_lineage(plan_lines(spark, sf)))
    shown = F.array_join(
        F.transform(F.array_sort(F.map_entries("params")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " "
    )
    return rows.withColumn("params", shown)
