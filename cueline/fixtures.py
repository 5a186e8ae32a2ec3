"""Views that give the sample tables the shape of session data.

Times are BIGINT milliseconds and only integer arithmetic is used, so another
engine computes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.operators.scan import running_count, scan, time_chunk

#: Letters of the sample prose and the ideographs that stand in
#: for them, so that script-dependent rules run over whole texts.
LATIN_LETTERS = "abcdefghijklmnopqrstuvwxyz"
IDEOGRAPHS = "的一是不了人我在有他這為之大來以個中上們到說國和地也"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One sample table, read as it lies."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cues(spark: SparkSession, sf: str) -> DataFrame:
    return cues_of(table(spark, sf, "conversations"))


def cues_of(conversations: DataFrame) -> DataFrame:
    turn = F.col("turn").cast("bigint")
    start = turn * 9000 + (F.col("conv_id") * 7919 + turn * 104729) % 5000
    return (
        conversations.select(
            F.col("conv_id").alias("session_id"),
            turn.alias("idx"),
            F.col("role").alias("speaker"),
            "text",
            start.alias("start_ms"),
        )
        .withColumn(
            "end_ms", F.col("start_ms") + 200 + (F.length("text").cast("bigint") * 37) % 11000
        )
    )


def turns(spark: SparkSession, sf: str) -> DataFrame:
    start = (F.col("event_id") * 7919) % 90000
    return table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("turn_idx"),
        start.alias("start_ms"),
        (start + 500 + (F.col("event_id") * 31) % 6000).alias("end_ms"),
        F.col("event_type").alias("speaker"),
    )


def words(spark: SparkSession, sf: str) -> DataFrame:
    return (
        cues(spark, sf)
        .select(
            "session_id",
            "idx",
            F.col("start_ms").alias("cue_ms"),
            F.posexplode(F.split("text", " ")).alias("pos", "word"),
        )
        .select(
            "session_id",
            "idx",
            F.col("pos").cast("bigint").alias("pos"),
            "word",
            (F.col("cue_ms") + F.col("pos") * 300).alias("start_ms"),
            (F.col("cue_ms") + F.col("pos") * 300 + F.length("word") * 40).alias("end_ms"),
        )
    )


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    return cues(spark, sf).select(
        "session_id",
        "idx",
        F.format_string("B%04d", F.col("idx") + 1).alias("block_id"),
        "speaker",
        "text",
        "start_ms",
        "end_ms",
        (F.col("idx") % 3 != 0).alias("keep_old"),
        (F.col("idx") % 4 != 0).alias("keep_new"),
    )


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Three level tracks per session; ``f`` counts frames from 1."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("session_id"),
        F.col("l_returnflag").alias("track"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_quantity",
        "l_extendedprice",
        "l_shipdate",
    )
    order = [
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_quantity",
        "l_extendedprice",
        "l_shipdate",
    ]
    numbered = scan(
        rows, ["session_id", "track"], order, time_chunk("l_orderkey", 20_000), f=running_count()
    )
    return numbered.select(
        "session_id", "track", "f", (F.lit(-60.0) + F.col("l_quantity")).alias("level_db")
    )


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id",
        "lang",
        F.posexplode(F.split("text", "\n")).alias("line_no", "line"),
    ).withColumn("line_no", F.col("line_no").cast("bigint"))


def ideographic(column: str) -> F.Column:
    """The text with its plain letters replaced by ideographs."""
    return F.translate(F.lower(F.col(column)), LATIN_LETTERS, IDEOGRAPHS)


def figures(spark: SparkSession, sf: str) -> DataFrame:
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: F.when(
            F.get(F.col("embedding"), i) > F.get(F.col("embedding"), (i + 1) % 64),
            F.shiftleft(F.lit(1).cast("bigint"), 0),
        ).otherwise(F.lit(0).cast("bigint")),
    )
    return table(spark, sf, "embeddings").select(
        F.col("label").cast("bigint").alias("session_id"),
        F.col("vec_id").cast("bigint").alias("vec_id"),
        "embedding",
        (F.col("vec_id") % 40).cast("bigint").alias("deck_page"),
        bits.alias("bits"),
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "ts",
        F.col("user_id").alias("session_id"),
        F.col("event_type").alias("stage"),
        F.when(F.col("event_id") % 7 == 0, "fail")
        .when(F.col("event_id") % 5 == 0, "warn")
        .otherwise("pass")
        .alias("status"),
        "event_id",
        "value",
    )


#: The same views for the SQL checks.
VIEWS: dict[str, str] = {
    "cues": """
        SELECT conv_id AS session_id, CAST(turn AS BIGINT) AS idx, role AS speaker, text,
               turn*9000 + (conv_id*7919 + turn*104729) % 5000 AS start_ms,
               turn*9000 + (conv_id*7919 + turn*104729) % 5000 + 200
                 + (length(text)*37) % 11000 AS end_ms
        FROM conversations""",
    "turns": """
        SELECT user_id AS session_id, event_id AS turn_idx, (event_id*7919) % 90000 AS start_ms,
               (event_id*7919) % 90000 + 500 + (event_id*31) % 6000 AS end_ms,
               event_type AS speaker
        FROM events""",
    "words": """
        SELECT session_id, idx, pos, word, cue_ms + pos*300 AS start_ms,
               cue_ms + pos*300 + length(word)*40 AS end_ms
        FROM (SELECT session_id, idx, start_ms AS cue_ms,
                     unnest(string_split(text, ' ')) AS word,
                     unnest(range(len(string_split(text, ' ')))) AS pos
              FROM cues)""",
    "blocks": """
        SELECT session_id, idx, printf('B%04d', idx + 1) AS block_id, speaker, text,
               start_ms, end_ms, idx % 3 <> 0 AS keep_old, idx % 4 <> 0 AS keep_new
        FROM cues""",
    "frames": """
        SELECT l_suppkey AS session_id, l_returnflag AS track,
               row_number() OVER (PARTITION BY l_suppkey, l_returnflag
                 ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity,
                          l_extendedprice, l_shipdate) AS f,
               -60.0 + l_quantity AS level_db
        FROM lineitem""",
    "doc_lines": """
        SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line,
               unnest(range(len(string_split(text, chr(10))))) AS line_no
        FROM documents""",
    "runs": """
        SELECT ts, user_id AS session_id, event_type AS stage,
               CASE WHEN event_id % 7 = 0 THEN 'fail' WHEN event_id % 5 = 0 THEN 'warn'
                    ELSE 'pass' END AS status, event_id, value
        FROM events""",
}
_NEEDS = {"words": ["cues"], "blocks": ["cues"]}


def with_views(names: str, body: str) -> str:
    """``WITH`` the named views, then ``body`` (which may start with more CTEs)."""
    wanted: list[str] = []
    for name in names.split():
        for need in [*_NEEDS.get(name, []), name]:
            if need not in wanted:
                wanted.append(need)
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in wanted)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
