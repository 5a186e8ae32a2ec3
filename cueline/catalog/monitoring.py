"""Run log queries, as tables and as streams drained once."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline import fixtures as fx
from cueline.catalog.folding import GREEDY, ordered_rows
from cueline.fixtures import with_views
from cueline.operators import folds as fo
from cueline.session import shared_folder
from cueline.streaming import keyed
from cueline.streaming import runs as ru

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, views: str | None = None, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(views, sql) if views else sql
        return fn

    return register


def log(spark, sf):
    return fx.runs(spark, sf).select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("session_id").cast("string").alias("session"),
        "stage",
        F.lit("t").alias("tool"),
        "status",
        F.concat(F.lit("e"), (F.col("event_id") % 3).cast("string")).alias("detail"),
        "event_id",
    )


def log_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The event table read as a stream."""
    schema = fx.table(spark, sf, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    n = F.col("event_id")
    return rows.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("string").alias("session"),
        F.col("event_type").alias("stage"),
        F.when(n % 7 == 0, "fail").when(n % 5 == 0, "warn").otherwise("pass").alias("status"),
        F.concat(F.lit("e"), (n % 3).cast("string")).alias("detail"),
    )


def drain(stream: DataFrame) -> DataFrame:
    """Run an append stream over what is there and read its output table."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/cueline-stream-{uuid.uuid4().hex}"
    (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{base}/rows")
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def json_record(stamp: str) -> Column:
    """A line of the run log."""
    return F.to_json(
        F.struct(
            F.date_format("ts", stamp).alias("ts"),
            "session",
            "stage",
            "tool",
            "status",
            F.create_map(F.lit("event"), F.col("event_id").cast("double")).alias("metrics"),
            "detail",
        )
    )


def shown(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return df


STAMP = "'%Y-%m-%d %H:%M:%S'"
HOURLY = f"""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), {STAMP}) AS window_start, strftime(time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR, {STAMP}) AS window_end,
    stage, count(*) AS runs, count(*) FILTER (status = 'fail') AS fails, count(*) FILTER (status = 'fail') / count(*) AS fail_rate
    FROM runs GROUP BY time_bucket(INTERVAL 1 HOUR, ts), stage"""


@query("fail_rate_tumbling", "runs", HOURLY)
def fail_rate_tumbling(spark, sf):
    return shown(ru.fail_rate(log(spark, sf)), "window_start", "window_end")


@query(
    "fail_rate_sliding",
    "runs",
    f"""WITH s AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL 10 MINUTE * k AS w, stage, status FROM runs, range(6) t(k))
    SELECT strftime(w, {STAMP}) AS window_start, strftime(w + INTERVAL 1 HOUR, {STAMP}) AS window_end, stage, count(*) AS runs,
      count(*) FILTER (status = 'fail') AS fails, count(*) FILTER (status = 'fail') / count(*) AS fail_rate FROM s GROUP BY w, stage""",
)
def fail_rate_sliding(spark, sf):
    return shown(ru.fail_rate(log(spark, sf), "1 hour", "10 minutes"), "window_start", "window_end")


@query(
    "run_sessions",
    "runs",
    f"""WITH l AS (SELECT session_id, ts, lag(ts) OVER (PARTITION BY session_id ORDER BY ts) AS p FROM runs),
    i AS (SELECT *, sum((p IS NULL OR ts - p >= INTERVAL 30 MINUTE)::INT) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM l)
    SELECT strftime(min(ts), {STAMP}) AS first_ts, strftime(max(ts) + INTERVAL 30 MINUTE, {STAMP}) AS last_ts, session_id::VARCHAR AS session, count(*) AS runs FROM i GROUP BY session_id, n""",
)
def run_sessions(spark, sf):
    return shown(ru.run_sessions(log(spark, sf)), "first_ts", "last_ts")


@query(
    "open_tickets",
    "runs",
    """SELECT stage AS source, session_id::VARCHAR AS session, 'e' || event_id % 3 AS issue, 'open' AS status, count(*) AS tickets FROM runs WHERE status = 'fail' GROUP BY ALL""",
)
def open_tickets(spark, sf):
    tickets = ru.open_tickets(log(spark, sf))
    return tickets.groupBy("source", "session", "issue", "status").agg(F.count("*").alias("tickets"))


@query(
    "close_tickets",
    "runs",
    """SELECT stage AS source, CASE WHEN event_id % 3 = 1 THEN 'closed' ELSE 'open' END AS status, event_id % 3 = 1 AS has_time, count(*) AS tickets
       FROM runs WHERE status = 'fail' GROUP BY ALL""",
)
def close_tickets(spark, sf):
    tickets = ru.close_tickets(ru.open_tickets(log(spark, sf)), F.col("issue") == "e1")
    return tickets.groupBy("source", "status", F.col("closed_ts").isNotNull().alias("has_time")).agg(
        F.count("*").alias("tickets")
    )


@query(
    "read_run_log",
    "runs",
    """SELECT session_id::VARCHAR AS session, stage, status, event_id::DOUBLE AS event FROM runs WHERE event_id % 10 <> 3""",
)
def read_run_log(spark, sf):
    """Runs written as JSON lines and read back; every tenth line is cut, each somewhere else."""
    record = json_record("yyyy-MM-dd'T'HH:mm:ss")
    line = F.when(F.col("event_id") % 10 == 3, F.substr(record, F.lit(1), (F.col("event_id") % 97 + 1).cast("int"))).otherwise(record)
    back = ru.parse_run_log(log(spark, sf).select(line.alias("value")))
    return back.select("session", "stage", "status", F.element_at("metrics", "event").alias("event"))


@query(
    "stream_fail_rate",
    "runs",
    f"""SELECT * FROM ({HOURLY}) WHERE strptime(window_end, {STAMP}) <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM runs)""",
)
def stream_fail_rate(spark, sf):
    """Windows the stream has closed: all but those the watermark has not passed."""
    stream = log_stream(spark, sf).withWatermark("ts", "10 minutes")
    return shown(drain(ru.fail_rate(stream)), "window_start", "window_end")


@query(
    "stream_run_sessions",
    "runs",
    f"""WITH l AS (SELECT session_id, ts, lag(ts) OVER (PARTITION BY session_id ORDER BY ts) AS p FROM runs),
    i AS (SELECT *, sum((p IS NULL OR ts - p >= INTERVAL 30 MINUTE)::INT) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM l)
    SELECT strftime(min(ts), {STAMP}) AS first_ts, strftime(max(ts) + INTERVAL 30 MINUTE, {STAMP}) AS last_ts, session_id::VARCHAR AS session, count(*) AS runs FROM i
    GROUP BY session_id, n HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM runs)""",
)
def stream_run_sessions(spark, sf):
    stream = log_stream(spark, sf).withWatermark("ts", "10 minutes")
    return shown(drain(ru.run_sessions(stream)), "first_ts", "last_ts")


@query("stream_open_tickets")
def stream_open_tickets(spark, sf):
    """Failures of one kind within the watermark open one ticket."""
    tickets = drain(ru.open_tickets(log_stream(spark, sf), "10 minutes"))
    return tickets.groupBy("source", "session", "issue", "status").agg(F.count("*").alias("tickets"))


@query(
    "stream_tickets",
    "runs",
    f"""WITH r AS (SELECT session_id::VARCHAR AS session, stage, status, event_id, epoch_us(ts) // 1000 AS ms FROM runs WHERE status IN ('fail', 'pass')),
    t AS (SELECT stage AS source, session, 'e' || event_id % 3 AS issue, ms, (SELECT min(p.ms) FROM r p
        WHERE p.status = 'pass' AND p.stage = f.stage AND p.session = f.session AND p.ms >= f.ms AND p.ms <= f.ms + 172800000) AS closed FROM r f WHERE status = 'fail')
    SELECT strftime(make_timestamp(ms * 1000), {STAMP}) AS ts, source, session, issue, '' AS suggestion, CASE WHEN closed IS NULL THEN 'open' ELSE 'closed' END AS status,
      strftime(make_timestamp(closed * 1000), {STAMP}) AS closed_ts FROM t WHERE coalesce(closed, ms + 172800000) <= (SELECT max(ms) - 600000 FROM r)""",
)
def stream_tickets(spark, sf):
    """The run log as JSON lines that a stream reads; a passed run closes the failures before it, two days leave one open."""
    path = f"{shared_folder(spark).rstrip('/')}/cueline-log-{uuid.uuid4().hex}"
    log(spark, sf).select(json_record("yyyy-MM-dd'T'HH:mm:ss.SSS")).write.text(path)
    return shown(drain(keyed.stream_tickets(ru.stream_runs(spark, path), "2 days")), "ts", "closed_ts")


@query(
    "stream_blocks",
    "cues",
    f"""WITH RECURSIVE {ordered_rows("""coalesce(start_ms - lag(end_ms) OVER w >= 3000, TRUE) AS hard, TRUE AS soft, end_ms AS hi, start_ms AS lo""")},
    {GREEDY.format(cmp=">", cap=45000)},
    b AS (SELECT r.session_id, op, min(r.start_ms) AS start_ms, arg_max(r.end_ms, r.n) AS end_ms, string_agg(r.text, '' ORDER BY r.n) AS text,
        string_agg(r.idx::VARCHAR, ',' ORDER BY r.n) AS cue_idx FROM seg JOIN r USING (session_id, n) GROUP BY r.session_id, op),
    n AS (SELECT *, printf('B%04d', row_number() OVER w) AS block_id, lead(start_ms) OVER w AS follows FROM b WINDOW w AS (PARTITION BY session_id ORDER BY op))
    SELECT session_id, block_id, start_ms, end_ms, text, cue_idx FROM n WHERE least(end_ms + 3000, coalesce(follows, end_ms + 3000)) <= (SELECT max(start_ms) - 10000 FROM cues)""",
)
def stream_blocks(spark, sf):
    """Blocks of a stream of cues that nothing can join any more, as one speaker's, so that they run into their length limit."""
    schema = fx.table(spark, sf, "conversations").schema
    # a stream reads folders: as a pattern, the name may be that of one file or of a folder of files
    rows = spark.readStream.schema(schema).parquet(f"{sf}/[c]onversations.parquet")
    cues = fx.cues_of(rows).withColumn("speaker", F.lit("S1")).withColumn("at", F.timestamp_millis(F.col("start_ms") + 86_400_000)).withWatermark("at", "10 seconds")
    blocks = fo.number_blocks(drain(keyed.stream_blocks(cues, 3000, 45_000)), size=90_000)
    return blocks.select("session_id", "block_id", "start_ms", "end_ms", "text", F.array_join("cue_idx", ",").alias("cue_idx"))
