"""The run log as a table or a stream, and the tickets it opens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_LOG = (
    "ts timestamp, session string, stage string, tool string, status string, "
    "metrics map<string,double>, detail string"
)
#: Column in which the parser leaves a line that it could not read.
DAMAGED = "_corrupt_record"
TICKETS = (
    "ts timestamp, source string, session string, issue string, suggestion string, "
    "status string, closed_ts timestamp"
)


def parse_run_log(lines: DataFrame, column: str = "value", schema: str = RUN_LOG) -> DataFrame:
    """Records of JSON lines; exactly the lines that cannot be parsed are skipped, wherever they were cut."""
    record = F.from_json(column, f"{schema}, {DAMAGED} string", {"columnNameOfCorruptRecord": DAMAGED})
    blank = F.trim(F.coalesce(F.col(column), F.lit(""))) == ""
    return lines.filter(~blank).select(record.alias("r")).select("r.*").filter(F.col(DAMAGED).isNull()).drop(DAMAGED)


def read_run_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """The append-only log under ``path``, at once or as it grows."""
    reader = spark.readStream if streaming else spark.read
    return parse_run_log(reader.text(path))


def stream_runs(spark: SparkSession, path: str, late: str = "10 minutes") -> DataFrame:
    """The log as a stream that waits ``late`` for rows out of order."""
    return read_run_log(spark, path, streaming=True).withWatermark("ts", late)


def fail_rate(
    runs: DataFrame, size: str = "1 hour", slide: str | None = None, by: Sequence[str] = ("stage",)
) -> DataFrame:
    """Runs and failures per window and stage; batch and streaming alike."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    counted = runs.groupBy(window.alias("w"), *by).agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") == "fail").alias("fails")
    )
    return counted.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        *by,
        "runs",
        "fails",
        (F.col("fails") / F.col("runs")).alias("fail_rate"),
    )


def run_sessions(runs: DataFrame, gap: str = "30 minutes", by: Sequence[str] = ("session",)) -> DataFrame:
    """Stretches of activity of one session, ended by ``gap`` of silence."""
    counted = runs.groupBy(F.session_window("ts", gap).alias("w"), *by).agg(F.count("*").alias("runs"))
    return counted.select(
        F.col("w.start").alias("first_ts"), F.col("w.end").alias("last_ts"), *by, "runs"
    )


def open_tickets(runs: DataFrame, late: str | None = None) -> DataFrame:
    """A ticket for every failed run; on a stream repeats within ``late`` count once."""
    tickets = runs.filter(F.col("status") == "fail").select(
        "ts",
        F.col("stage").alias("source"),
        "session",
        F.coalesce("detail", F.lit("")).alias("issue"),
        F.lit("").alias("suggestion"),
        F.lit("open").alias("status"),
        F.lit(None).cast("timestamp").alias("closed_ts"),
    )
    if late is None:
        return tickets
    return tickets.withWatermark("ts", late).dropDuplicatesWithinWatermark(["source", "session", "issue"])


def close_tickets(tickets: DataFrame, predicate: Column, at: Column | None = None) -> DataFrame:
    """Open tickets that satisfy ``predicate`` become closed; others stay as they are."""
    hit = (F.col("status") == "open") & F.coalesce(predicate, F.lit(False))
    when = at if at is not None else F.current_timestamp()
    return tickets.withColumn("closed_ts", F.when(hit, when).otherwise(F.col("closed_ts"))).withColumn(
        "status", F.when(hit, "closed").otherwise(F.col("status"))
    )
