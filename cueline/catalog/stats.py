"""Statistics, ranking and budget queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueline import fixtures as fx
from cueline.fixtures import with_views
from cueline.functions import text as tx
from cueline.plans import ordering as po
from cueline.operators import scores as sc

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, views: str | None = None, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(views, sql) if views else sql
        return fn

    return register


VOWELS = "[aeiou]"


def pitch_frames(spark, sf):
    """The loudest track of every 300 ms frame, with a pitch where it is loud."""
    loud = F.col("level_db") > -35
    return (
        fx.frames(spark, sf)
        .groupBy("session_id", "f")
        .agg(F.max("level_db").alias("level_db"))
        .select(
            "session_id",
            (F.col("f") - 1).alias("f"),
            "level_db",
            loud.alias("voiced"),
            F.when(loud & (F.col("f") % 7 != 0), F.lit(200.0) + F.col("level_db") * 2).alias("f0"),
        )
    )


FEATURES = """
    pf AS (SELECT session_id, f - 1 AS f, level_db, level_db > -35 AS voiced,
             CASE WHEN level_db > -35 AND f % 7 <> 0 THEN 200.0 + level_db * 2 END AS f0 FROM (SELECT session_id, f, max(level_db) AS level_db FROM frames GROUP BY session_id, f)),
    sp AS (SELECT session_id, idx, start_ms // 300 AS fa, greatest(start_ms // 300 + 1, end_ms // 300) AS fb FROM cues),
    m AS (SELECT sp.session_id, sp.idx, quantile_cont(level_db, 0.75) AS rms_db,
            quantile_cont(f0, 0.75) FILTER (voiced) AS f0_p75,
            CASE WHEN count(f0) FILTER (voiced) >= 4 THEN quantile_cont(f0, 0.9) FILTER (voiced)
                 - quantile_cont(f0, 0.1) FILTER (voiced) END AS f0_range, avg(voiced::INT) AS voiced_ratio
          FROM sp JOIN pf ON pf.session_id = sp.session_id AND pf.f >= sp.fa AND pf.f < sp.fb GROUP BY ALL),
    feat AS (SELECT c.session_id, c.idx, c.speaker, c.start_ms, coalesce(rms_db, -80.0) AS rms_db, f0_p75, f0_range,
               (length(text) - length(regexp_replace(text, '[aeiou]', '', 'g')))::DOUBLE
                 / greatest(0.2, (end_ms - start_ms) / 1000.0) AS rate,
               coalesce(voiced_ratio, 0.0) AS voiced_ratio
             FROM cues c LEFT JOIN m USING (session_id, idx))"""


def features(spark, sf):
    return sc.segment_features(
        fx.cues(spark, sf), pitch_frames(spark, sf), hop_ms=300, char_class=VOWELS
    )


@query(
    "segment_features",
    "cues frames",
    f"""WITH {FEATURES} SELECT session_id, idx, rms_db, f0_p75, f0_range, round(rate, 6) AS rate,
        round(voiced_ratio, 6) AS voiced_ratio FROM feat""",
)
def segment_features(spark, sf):
    return features(spark, sf).select(
        "session_id",
        "idx",
        "rms_db",
        "f0_p75",
        "f0_range",
        F.round("rate", 6).alias("rate"),
        F.round("voiced_ratio", 6).alias("voiced_ratio"),
    )


_KEYS = ("rms_db", "f0_p75", "f0_range", "rate")
_W = {"rms_db": 0.35, "f0_p75": 0.35, "f0_range": 0.10, "rate": 0.20}
SCORED = f"""{FEATURES},
    st AS (SELECT session_id, speaker, {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _KEYS)}
           FROM feat GROUP BY session_id, speaker),
    zs AS (SELECT feat.*, {', '.join(f"round_even(coalesce(greatest(-3.0, least(3.0, CASE WHEN {c} IS NULL THEN NULL ELSE ({c} - m_{c}) / CASE WHEN s_{c} < 1e-9 THEN 1.0 ELSE s_{c} END END)) , 0.0) * ({c} IS NOT NULL)::INT, 3) AS z_{c}" for c in _KEYS)}
           FROM feat JOIN st USING (session_id, speaker)),
    -- in hundred thousandths, so that halves are halves; they go to the even tenth
    hs AS (SELECT *, greatest(0, least(10000000, 5000000 + 18 * ({' + '.join(f'round(z_{c} * 1000)::BIGINT * {round(w * 100)}' for c, w in _W.items())}))) AS h FROM zs),
    ex AS (SELECT * EXCLUDE (h), (h // 10000 + CASE WHEN h % 10000 > 5000 OR h % 10000 = 5000 AND h // 10000 % 2 = 1 THEN 1 ELSE 0 END)::DOUBLE / 10 AS excitement FROM hs)"""


def scored(spark, sf):
    return sc.excitement(features(spark, sf))


@query(
    "excitement",
    "cues frames",
    f"WITH {SCORED} SELECT session_id, idx, excitement, z_rms_db, z_rate FROM ex",
)
def excitement(spark, sf):
    return scored(spark, sf).select("session_id", "idx", "excitement", "z_rms_db", "z_rate")


@query(
    "highlights",
    "cues frames",
    f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY excitement DESC, idx) AS rk,
          count(*) OVER (PARTITION BY session_id) AS n FROM ex)
        SELECT session_id, idx, start_ms, excitement FROM r WHERE rk <= greatest(3, round_even(n * 25.0 / 100.0, 0)) AND excitement >= 52""",
)
def highlights(spark, sf):
    out = sc.highlights(scored(spark, sf), pct=25.0, min_score=52.0)
    return out.select("session_id", "idx", "start_ms", "excitement")


@query(
    "visible_budget",
    "runs",
    """WITH d AS (SELECT session_id, 60000 * (1 + session_id % 4) AS duration_ms FROM runs GROUP BY session_id),
    h AS (SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY value DESC, event_id) AS rk FROM runs WHERE value >= 6.0)
    SELECT r.session_id, r.event_id, coalesce(h.rk <= floor(d.duration_ms / 60000.0 * 2.0), FALSE) AS visible
    FROM runs r JOIN d USING (session_id) LEFT JOIN h USING (session_id, event_id)""",
)
def visible_budget(spark, sf):
    events = fx.runs(spark, sf).select("session_id", "event_id", F.col("value").alias("score"))
    sessions = events.select("session_id").distinct().withColumn(
        "duration_ms", (F.col("session_id") % 4 + 1) * 60000
    )
    return sc.visible_budget(events, sessions).drop("score")


WINDOWS = """w AS (SELECT session_id, track, (f - 1) // 12 AS w, avg(pow(10.0, level_db / 10.0)) AS energy,
       max(level_db) - quantile_cont(level_db, 0.1) AS spread_db FROM frames GROUP BY ALL)"""


@query(
    "quiet_and_flat",
    "frames",
    f"""WITH {WINDOWS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id, track ORDER BY energy, w) AS rk,
          count(*) OVER (PARTITION BY session_id, track) AS n FROM w),
    p AS (SELECT *, row_number() OVER (PARTITION BY session_id, track ORDER BY energy, w) AS place FROM r
          WHERE rk <= greatest(8, ceil(n * 0.1)) AND spread_db <= 38.0)
    SELECT session_id, track, w, round(energy, 9) AS energy, spread_db, place FROM p WHERE place <= 2""",
)
def quiet_and_flat(spark, sf):
    by = ["session_id", "track"]
    windows = sc.window_stats(fx.frames(spark, sf), by, 12)
    out = sc.quiet_and_flat(windows, by, want=2, max_spread_db=38.0)
    return out.withColumn("energy", F.round("energy", 9))


@query(
    "long_blocks",
    "cues",
    """SELECT session_id, idx, end_ms - start_ms AS length_ms, place FROM (SELECT *, row_number() OVER (
         PARTITION BY session_id ORDER BY end_ms - start_ms DESC, idx) AS place FROM cues WHERE end_ms - start_ms > 8000)
       WHERE place <= 5""",
)
def long_blocks(spark, sf):
    return sc.long_blocks(fx.cues(spark, sf)).select("session_id", "idx", "length_ms", "place")


@query(
    "retention_ratio",
    None,
    r"""WITH m AS (SELECT doc_id, length(regexp_replace(text, '\s+', '', 'g')) AS a,
          length(regexp_replace(regexp_replace(text, '[^a-zA-Z\s]', '', 'g'), '\s+', '', 'g')) AS b FROM documents)
    SELECT doc_id, round(b / greatest(a, 1), 6) AS ratio, b / greatest(a, 1) BETWEEN 0.95 AND 1.05 AS in_band,
           b / greatest(a, 1) < 0.85 AS too_low FROM m""",
)
def retention_ratio(spark, sf):
    """Letters kept between the raw text and a stage without marks and digits."""
    docs = fx.table(spark, sf, "documents")
    bare = F.regexp_replace("text", r"[^a-zA-Z\s]", "")
    stages = F.array(
        F.struct(F.lit("raw").alias("stage"), tx.no_space_length(F.col("text")).alias("no_space")),
        F.struct(F.lit("clean").alias("stage"), tx.no_space_length(bare).alias("no_space")),
    )
    metrics = docs.select("doc_id", F.explode(stages).alias("s")).select("doc_id", "s.*")
    return sc.retention_ratio(metrics, "raw", "clean")


@query(
    "latest_version",
    None,
    """WITH v AS (SELECT o_custkey AS session_id, o_orderkey % 9 AS version, o_orderdate AS mtime, o_orderkey AS k FROM orders)
       SELECT session_id, max(version) AS version, arg_max(k, (version, mtime, k))::VARCHAR AS name, max(version) + 1 AS next_version
       FROM v GROUP BY session_id""",
)
def latest_version(spark, sf):
    orders = fx.table(spark, sf, "orders")
    versions = orders.select(
        F.col("o_custkey").alias("session_id"),
        (F.col("o_orderkey") % 9).alias("version"),
        F.col("o_orderdate").alias("mtime"),
        F.col("o_orderkey").alias("name"),
    )
    return sc.latest_version(versions).withColumn("name", F.col("name").cast("string"))


@query(
    "timeline_merge",
    "cues turns",
    """WITH e AS (SELECT session_id, start_ms AS t_ms, 2 AS rank, 'para' AS kind, idx AS ref FROM cues
         UNION ALL SELECT session_id, start_ms, 0, 'frame', turn_idx FROM turns
         UNION ALL SELECT session_id, end_ms, 1, 'pause', idx FROM (SELECT *, lead(start_ms) OVER (PARTITION BY session_id ORDER BY idx) AS nxt FROM cues) WHERE nxt - end_ms >= 1500)
       SELECT session_id, t_ms, kind, ref, row_number() OVER (PARTITION BY session_id ORDER BY t_ms, rank, ref) AS seq FROM e""",
)
def timeline_merge(spark, sf):
    from cueline.operators.intervals import find_pauses

    cues = fx.cues(spark, sf)
    paragraphs = cues.select("session_id", F.col("start_ms").alias("t_ms"), F.col("idx").alias("ref"))
    frames = fx.turns(spark, sf).select(
        "session_id", F.col("start_ms").alias("t_ms"), F.col("turn_idx").alias("ref")
    )
    pauses = find_pauses(cues.withColumn("ref", F.col("idx")), 1500).select("session_id", "t_ms")
    ends = cues.select("session_id", F.col("end_ms").alias("t_ms"), F.col("idx").alias("ref"))
    pauses = pauses.join(ends, ["session_id", "t_ms"])
    return po.timeline_merge({"frame": frames, "pause": pauses, "para": paragraphs}).select(
        "session_id", "t_ms", "kind", "ref", "seq"
    )


@query(
    "insert_rows_before",
    "blocks",
    """WITH p AS (SELECT session_id, reach AS start_ms, start_ms AS end_ms FROM (SELECT *, max(end_ms) OVER (PARTITION BY session_id
            ORDER BY start_ms, end_ms, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM blocks WHERE keep_old)
          WHERE start_ms - reach > 900),
    pn AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY start_ms) AS no FROM p)
    SELECT pn.session_id, printf('P%04d', no) AS row_id, (SELECT min(idx) FROM blocks b WHERE b.session_id = pn.session_id
           AND b.start_ms // 1000 * 1000 >= pn.start_ms) AS before_idx, pn.start_ms // 1000 % 2 = 0 AS keep FROM pn""",
)
def insert_rows_before(spark, sf):
    from cueline.operators.intervals import collapsible_pauses

    blocks = fx.blocks(spark, sf)
    pauses = collapsible_pauses(blocks.filter("keep_old"))
    marks = pauses.select(
        "session_id",
        F.floor(F.col("start_ms") / 1000).alias("second"),
        (F.floor(F.col("start_ms") / 1000) % 2 == 0).alias("keep"),
    )
    return po.insert_rows_before(blocks, pauses, marks).select(
        "session_id", "row_id", "before_idx", "keep"
    )


@query(
    "cfar_threshold",
    "frames",
    """WITH q AS (SELECT session_id, track, quantile_cont(level_db, 0.995) AS t FROM frames WHERE level_db < -30 GROUP BY ALL)
       SELECT session_id, track, coalesce(t, 10.0) AS threshold FROM (SELECT DISTINCT session_id, track FROM frames) LEFT JOIN q USING (session_id, track)""",
)
def cfar_threshold(spark, sf):
    frames = fx.frames(spark, sf)
    negatives = frames.filter("level_db < -30")
    return sc.cfar_threshold(negatives, "level_db", default=10.0, groups=frames)
