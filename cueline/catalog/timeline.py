"""Interval, join and speaker queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline import fixtures as fx
from cueline.fixtures import with_views
from cueline.operators import intervals as iv
from cueline.operators import speakers as sp
from cueline.operators.scan import running_sum, scan, time_chunk

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, views: str | None = None, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(views, sql) if views else sql
        return fn

    return register


def merged(source: str, by: str, gap: int, inclusive: bool = False) -> str:
    """SQL for the union of intervals of ``source``."""
    cmp = ">" if inclusive else ">="
    return f"""
        SELECT {by}, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS parts
        FROM (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms - reach {cmp} {gap} THEN 1 ELSE 0 END)
                     OVER (PARTITION BY {by} ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island
              FROM (SELECT {by}, start_ms, end_ms, max(end_ms) OVER (PARTITION BY {by}
                       ORDER BY start_ms, end_ms
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
                    FROM {source} WHERE end_ms > start_ms))
        GROUP BY {by}, island"""


# --- intervals -------------------------------------------------------------


@query("merge_intervals", "cues", merged("cues", "session_id", 200))
def merge_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return iv.merge_intervals(fx.cues(spark, sf))


@query("merge_intervals_inclusive", "turns", merged("turns", "session_id", 100, True))
def merge_inclusive(spark, sf):
    return iv.merge_intervals(fx.turns(spark, sf), min_gap_ms=100, inclusive=True)


@query(
    "session_time_budget",
    "cues",
    f"""WITH m AS ({merged("cues", "session_id", 200)})
    SELECT session_id, count(*) AS islands, CAST(sum(end_ms - start_ms) AS BIGINT) AS kept_ms,
           CAST(max(end_ms) - min(start_ms) - sum(end_ms - start_ms) AS BIGINT) AS gap_ms
    FROM m GROUP BY session_id""",
)
def session_time_budget(spark, sf):
    """Per session: islands of speech, kept time and time in gaps."""
    islands = iv.merge_intervals(fx.cues(spark, sf))
    span = F.sum(F.col("end_ms") - F.col("start_ms"))
    return islands.groupBy("session_id").agg(
        F.count("*").alias("islands"),
        span.alias("kept_ms"),
        (F.max("end_ms") - F.min("start_ms") - span).alias("gap_ms"),
    )


SUBTRACT = """
    WITH m AS ({removals}),
    hits AS (SELECT c.session_id, c.idx, c.start_ms, c.end_ms, m.start_ms AS rs, m.end_ms AS re
             FROM cues c JOIN m ON c.session_id = m.session_id
              AND c.start_ms < m.end_ms AND c.end_ms > m.start_ms),
    pieces AS (
      SELECT session_id, idx, greatest(start_ms, coalesce(lag(re) OVER (
               PARTITION BY session_id, idx ORDER BY rs), start_ms)) AS a, rs AS b FROM hits
      UNION ALL
      SELECT c.session_id, c.idx, greatest(c.start_ms, coalesce(max(h.re), c.start_ms)), c.end_ms
      FROM cues c LEFT JOIN hits h ON c.session_id = h.session_id AND c.idx = h.idx
      GROUP BY c.session_id, c.idx, c.start_ms, c.end_ms)
    SELECT session_id, idx, a AS start_ms, b AS end_ms FROM pieces WHERE b > a AND b - a >= {frag}"""


@query(
    "subtract_intervals",
    "cues turns",
    SUBTRACT.format(removals=merged("turns", "session_id", 0), frag=120),
)
def subtract_intervals(spark, sf):
    keep = fx.cues(spark, sf).select("session_id", "idx", "start_ms", "end_ms")
    return iv.subtract_intervals(keep, fx.turns(spark, sf), key=["idx"])


@query(
    "subtract_intervals_no_minimum",
    "cues turns",
    SUBTRACT.format(removals=merged("turns", "session_id", 0), frag=0),
)
def subtract_no_minimum(spark, sf):
    keep = fx.cues(spark, sf).select("session_id", "idx", "start_ms", "end_ms")
    return iv.subtract_intervals(keep, fx.turns(spark, sf), key=["idx"], min_frag_ms=0)


@query(
    "interval_join",
    "cues turns",
    """SELECT c.session_id, c.idx, t.turn_idx,
              least(c.end_ms, t.end_ms) - greatest(c.start_ms, t.start_ms) AS overlap_ms
       FROM cues c JOIN turns t ON c.session_id = t.session_id
        AND c.start_ms < t.end_ms AND c.end_ms > t.start_ms""",
)
def interval_join(spark, sf):
    pairs = iv.interval_join(fx.cues(spark, sf), fx.turns(spark, sf))
    return pairs.select(
        "session_id", "idx", F.col("r_turn_idx").alias("turn_idx"), iv.overlap_ms().alias("overlap_ms")
    )


@query(
    "coverage",
    "cues turns",
    f"""WITH m AS ({merged("turns", "session_id", 0)})
    SELECT c.session_id, c.idx, CAST(coalesce(sum(least(c.end_ms, m.end_ms)
             - greatest(c.start_ms, m.start_ms)) FILTER (m.start_ms IS NOT NULL), 0) AS BIGINT) AS covered_ms
    FROM cues c LEFT JOIN m ON c.session_id = m.session_id
      AND c.start_ms < m.end_ms AND c.end_ms > m.start_ms
    GROUP BY c.session_id, c.idx""",
)
def coverage(spark, sf):
    ranges = iv.merge_intervals(fx.turns(spark, sf), min_gap_ms=0)
    spans = fx.cues(spark, sf).select("session_id", "idx", "start_ms", "end_ms")
    return iv.coverage(spans, ranges).select("session_id", "idx", "covered_ms")


GAPS = """
    SELECT session_id, printf('G%04d', row_number() OVER (PARTITION BY session_id ORDER BY idx)) AS gap_id,
           gap_start AS start_ms, start_ms AS end_ms, block_id AS before, FALSE AS keep
    FROM (SELECT *, lag(end_ms, 1, 0) OVER (PARTITION BY session_id ORDER BY idx) AS gap_start FROM blocks)
    WHERE start_ms - gap_start >= 2000"""


@query("find_gaps", "blocks", GAPS)
def find_gaps(spark, sf):
    return iv.find_gaps(fx.blocks(spark, sf))


@query(
    "find_pauses",
    "cues",
    """SELECT session_id, end_ms AS t_ms, round((nxt - end_ms) / 1000.0, 1) AS gap_s
       FROM (SELECT *, lead(start_ms) OVER (PARTITION BY session_id ORDER BY idx) AS nxt FROM cues)
       WHERE nxt - end_ms >= 1500""",
)
def find_pauses(spark, sf):
    return iv.find_pauses(fx.cues(spark, sf), 1500)


PAUSES = """
    SELECT session_id, reach AS start_ms, start_ms AS end_ms
    FROM (SELECT session_id, start_ms, end_ms, max(end_ms) OVER (PARTITION BY session_id
            ORDER BY start_ms, end_ms, block_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
          FROM blocks WHERE keep_old)
    WHERE start_ms - reach > 900"""


@query(
    "collapsible_pauses",
    "blocks",
    f"""WITH p AS ({PAUSES}), m AS ({merged("p", "session_id", 0, True)})
        SELECT session_id, start_ms, end_ms FROM m""",
)
def collapsible_pauses(spark, sf):
    return iv.collapsible_pauses(fx.blocks(spark, sf).filter("keep_old"))


RUNS = """
    SELECT session_id, track, (min(f) * 10)::BIGINT AS start_ms, ((max(f) + 1) * 10)::BIGINT AS end_ms
    FROM (SELECT *, f - row_number() OVER (PARTITION BY session_id, track ORDER BY f) AS grp
          FROM frames WHERE level_db < -38.0)
    GROUP BY session_id, track, grp HAVING (max(f) + 1 - min(f)) * 10 >= {least}"""


@query("runs_of", "frames", RUNS.format(least=20))
def runs_of(spark, sf):
    return iv.runs_of(fx.frames(spark, sf), F.col("level_db") < -38.0, min_ms=20)


@query(
    "silence_runs_to_last_frame",
    "frames",
    """WITH last AS (SELECT session_id, track, max(f) AS mf FROM frames GROUP BY ALL)
    SELECT session_id, track, (min(f) * 10)::BIGINT AS start_ms, (least(max(f) + 1, any_value(mf)) * 10)::BIGINT AS end_ms
    FROM (SELECT *, f - row_number() OVER (PARTITION BY session_id, track ORDER BY f) AS grp
          FROM frames WHERE level_db < -38.0) JOIN last USING (session_id, track)
    GROUP BY session_id, track, grp HAVING (least(max(f) + 1, any_value(mf)) - min(f)) * 10 >= 20""",
)
def silence_runs(spark, sf):
    return iv.runs_of(
        fx.frames(spark, sf), F.col("level_db") < -38.0, min_ms=20, to_next_frame=False
    )


@query(
    "close_and_filter_runs",
    "frames",
    f"""WITH r AS ({RUNS.format(least=0)}), m AS ({merged("r", "session_id, track", 30)})
        SELECT session_id, track, start_ms, end_ms FROM m WHERE end_ms - start_ms >= 60""",
)
def close_and_filter_runs(spark, sf):
    runs = iv.runs_of(fx.frames(spark, sf), F.col("level_db") < -38.0)
    return iv.close_and_filter_runs(runs, gap_ms=30, min_ms=60)


def cut_map(spark: SparkSession, sf: str) -> DataFrame:
    kept = iv.merge_intervals(
        fx.blocks(spark, sf).filter("keep_old").select("session_id", "start_ms", "end_ms")
    )
    length = F.col("end_ms") - F.col("start_ms")
    placed = scan(
        kept,
        "session_id",
        ["start_ms"],
        time_chunk("start_ms"),
        dst_start_ms=running_sum(length, inclusive=False),
    )
    return placed.select(
        "session_id",
        F.col("start_ms").alias("src_start_ms"),
        F.col("end_ms").alias("src_end_ms"),
        "dst_start_ms",
    )


CUT_MAP = f"""
    kept AS (SELECT session_id, start_ms, end_ms FROM blocks WHERE keep_old),
    kept_m AS ({merged("kept", "session_id", 200)}),
    cut_map AS (SELECT session_id, start_ms AS src_start_ms, end_ms AS src_end_ms,
                  coalesce(sum(end_ms - start_ms) OVER (PARTITION BY session_id ORDER BY start_ms
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dst_start_ms FROM kept_m)"""


def _points(spark, sf):
    return fx.turns(spark, sf).select(
        "session_id", F.col("turn_idx").alias("idx"), F.col("start_ms").alias("t_ms")
    )


@query(
    "asof_remap",
    "blocks turns",
    f"""WITH {CUT_MAP}
    SELECT p.session_id, p.turn_idx AS idx, p.start_ms AS t_ms,
      CAST(coalesce(
        (SELECT max(c.dst_start_ms + (p.start_ms - c.src_start_ms) / 1.25) FROM cut_map c
          WHERE c.session_id = p.session_id AND c.src_start_ms <= p.start_ms AND p.start_ms < c.src_end_ms),
        (SELECT arg_min(c.dst_start_ms, c.src_start_ms) FROM cut_map c
          WHERE c.session_id = p.session_id AND c.src_start_ms > p.start_ms)) AS DOUBLE) AS dst_ms
    FROM turns p""",
)
def asof_remap(spark, sf):
    return iv.asof_remap(_points(spark, sf), cut_map(spark, sf), tempo=1.25)


@query(
    "tolerant_remap",
    "blocks turns",
    f"""WITH {CUT_MAP}
    SELECT p.session_id, p.turn_idx AS idx, p.start_ms AS t_ms,
      CAST(max(c.dst_start_ms + (p.start_ms - c.src_start_ms) / 1.25) AS DOUBLE) AS dst_ms
    FROM turns p LEFT JOIN cut_map c ON c.session_id = p.session_id
     AND c.src_start_ms - 500 <= p.start_ms AND p.start_ms <= c.src_end_ms + 500
    GROUP BY ALL""",
)
def tolerant_remap(spark, sf):
    return iv.tolerant_remap(_points(spark, sf), cut_map(spark, sf), tempo=1.25)


def _silences(spark, sf):
    return fx.turns(spark, sf).select("session_id", "start_ms", "end_ms").distinct()


SILENT = "sil AS (SELECT DISTINCT session_id, start_ms, end_ms FROM turns)"
#: Gaps of the words themselves, as a silence detector that knows the words would give them.
WORD_GAPS = "sil AS (SELECT DISTINCT session_id, end_ms AS start_ms, start_ms + 300 AS end_ms FROM words WHERE start_ms + 300 > end_ms)"
#: Silences narrowed word by word: ``cl`` with lo_ms and hi_ms, null where a word lies inside.
CLAMPED = """tw AS (SELECT s.session_id, s.start_ms, s.end_ms, w.start_ms AS a, w.end_ms AS b, row_number() OVER (PARTITION BY s.session_id, s.start_ms, s.end_ms ORDER BY w.start_ms, w.end_ms) AS n
      FROM sil s JOIN words w ON w.session_id = s.session_id AND w.start_ms < s.end_ms AND w.end_ms > s.start_ms),
    na(session_id, start_ms, end_ms, n, lo, hi, ok) AS (SELECT session_id, start_ms, end_ms, 0::BIGINT, start_ms, end_ms, TRUE FROM sil
      UNION ALL SELECT na.session_id, na.start_ms, na.end_ms, tw.n, CASE WHEN ap OR a > lo THEN lo ELSE greatest(lo, b + 50) END,
        CASE WHEN ap OR a <= lo OR b < hi THEN hi ELSE least(hi, a - 50) END, ok AND (ap OR a <= lo OR b >= hi)
      FROM na JOIN tw ON tw.session_id = na.session_id AND tw.start_ms = na.start_ms AND tw.end_ms = na.end_ms AND tw.n = na.n + 1, LATERAL (SELECT NOT ok OR b <= lo OR a >= hi AS ap) x),
    la AS (SELECT session_id, start_ms, end_ms, arg_max(lo, n) AS lo, arg_max(hi, n) AS hi, arg_max(ok, n) AS ok FROM na GROUP BY ALL),
    cl AS (SELECT session_id, start_ms, end_ms, CASE WHEN ok AND hi > lo THEN lo END AS lo_ms, CASE WHEN ok AND hi > lo THEN hi END AS hi_ms FROM la)"""


@query("clamp_to_words", "turns words", f"WITH RECURSIVE {SILENT}, {CLAMPED} SELECT session_id, start_ms, end_ms, lo_ms, hi_ms FROM cl")
def clamp_to_words(spark, sf):
    return iv.clamp_to_words(_silences(spark, sf), fx.words(spark, sf))


@query(
    "tighten_pauses",
    "cues words",
    f"""WITH RECURSIVE {WORD_GAPS}, {CLAMPED}, m AS ({merged("cues", "session_id", 2000)})
    SELECT m.session_id, cl.lo_ms + 30 AS start_ms, cl.hi_ms - 30 AS end_ms FROM m JOIN cl ON cl.session_id = m.session_id
      AND cl.hi_ms - cl.lo_ms > 100 AND cl.start_ms > m.start_ms + 300 AND cl.end_ms < m.end_ms - 300""",
)
def tighten_pauses(spark, sf):
    """The gaps of the words inside merged cues, each cut down to 60 ms."""
    ranges = iv.merge_intervals(fx.cues(spark, sf), min_gap_ms=2000)
    words = fx.words(spark, sf)
    gaps = words.select("session_id", F.col("end_ms").alias("start_ms"), (F.col("start_ms") + 300).alias("end_ms"))
    return iv.tighten_pauses(ranges, gaps.filter("end_ms > start_ms").distinct(), words, max_pause_ms=100, keep_ms=60)


@query(
    "snap_boundaries",
    "cues turns words",
    f"""WITH RECURSIVE {SILENT}, {CLAMPED},
    e AS (SELECT session_id, idx, TRUE AS st, start_ms AS t FROM cues UNION ALL SELECT session_id, idx, FALSE, end_ms FROM cues),
    h AS (SELECT e.session_id, e.idx, e.st, e.t, min({{'a': cl.start_ms, 'b': cl.end_ms, 'lo': cl.lo_ms, 'hi': cl.hi_ms}}) AS s FROM e LEFT JOIN cl ON cl.session_id = e.session_id
      AND e.t >= cl.start_ms - 400 AND e.t <= cl.end_ms + 400 GROUP BY ALL),
    v AS (SELECT *, CASE WHEN s.a IS NULL THEN t::DOUBLE WHEN s.b - s.a > 1000 AND s.lo IS NULL THEN t::DOUBLE
      WHEN s.b - s.a > 1000 AND s.hi - s.lo > 1000 THEN (CASE WHEN st THEN s.hi - 120 ELSE s.lo + 120 END)::DOUBLE ELSE (s.a + s.b) / 2.0 END AS x FROM h)
    SELECT session_id, idx, max(CASE WHEN st THEN x END) AS start_ms, max(CASE WHEN NOT st THEN x END) AS end_ms FROM v GROUP BY session_id, idx""",
)
def snap_boundaries(spark, sf):
    ranges = fx.cues(spark, sf).select("session_id", "idx", "start_ms", "end_ms")
    return iv.snap_boundaries(ranges, _silences(spark, sf), fx.words(spark, sf))


@query(
    "word_guard",
    "cues words",
    """WITH hit AS (SELECT c.session_id, c.idx, e.is_start, e.t,
              arg_min(w.start_ms, (w.start_ms, w.end_ms)) AS ws, arg_min(w.end_ms, (w.start_ms, w.end_ms)) AS we
       FROM cues c CROSS JOIN LATERAL (SELECT TRUE AS is_start, c.start_ms AS t
                                 UNION ALL SELECT FALSE, c.end_ms) e
       LEFT JOIN words w ON w.session_id = c.session_id AND w.start_ms + 30 < e.t AND e.t < w.end_ms - 30
       WHERE c.end_ms > c.start_ms GROUP BY ALL)
    SELECT session_id, idx, max(CASE WHEN is_start THEN coalesce(ws - 20, t) END) AS start_ms,
           max(CASE WHEN NOT is_start THEN coalesce(we + 20, t) END) AS end_ms
    FROM hit GROUP BY session_id, idx""",
)
def word_guard(spark, sf):
    ranges = fx.cues(spark, sf).select("session_id", "idx", "start_ms", "end_ms")
    return iv.word_guard(ranges, fx.words(spark, sf))


@query(
    "cluster_1d",
    "turns",
    """SELECT session_id, turn_idx, CAST(sum(CASE WHEN prev IS NULL OR start_ms - prev > 2500 THEN 1 ELSE 0 END)
         OVER (PARTITION BY session_id ORDER BY start_ms, turn_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster
       FROM (SELECT *, lag(start_ms) OVER (PARTITION BY session_id ORDER BY start_ms, turn_idx) AS prev FROM turns)""",
)
def cluster_1d(spark, sf):
    out = iv.cluster_1d(
        fx.turns(spark, sf), "start_ms", 2500, "session_id", time_chunk("start_ms"), ["turn_idx"]
    )
    return out.select("session_id", "turn_idx", "cluster")


@query(
    "dedupe_consecutive",
    "turns",
    """SELECT session_id, turn_idx, speaker FROM (SELECT *, lag(speaker) OVER (
         PARTITION BY session_id ORDER BY turn_idx) AS prev FROM turns)
       WHERE prev IS NULL OR prev <> speaker""",
)
def dedupe_consecutive(spark, sf):
    rows = fx.turns(spark, sf).select("session_id", "turn_idx", "speaker")
    return iv.dedupe_consecutive(rows, "speaker", "session_id", ["turn_idx"], time_chunk("turn_idx", 4096))


@query(
    "classify_gaps",
    "blocks frames",
    f"""WITH gaps AS ({GAPS}),
    fr AS (SELECT session_id, f * 300 AS start_ms, f * 300 + 300 AS end_ms, max(level_db) AS level_db
           FROM frames GROUP BY session_id, f),
    ins AS (SELECT g.session_id, g.gap_id, g.start_ms AS gs, g.end_ms AS ge, fr.start_ms, fr.end_ms, fr.level_db
            FROM gaps g JOIN fr ON fr.session_id = g.session_id
             AND fr.start_ms >= g.start_ms AND fr.end_ms <= g.end_ms),
    loud AS (SELECT * FROM ins WHERE level_db > -20.0),
    b AS (SELECT session_id, gap_id, start_ms, end_ms FROM ({merged("loud", "session_id, gap_id", 350)})
          WHERE end_ms - start_ms >= 600),
    pk AS (SELECT b.session_id, b.gap_id, b.start_ms, b.end_ms, max(l.level_db) AS peak_db
           FROM b JOIN loud l ON l.session_id = b.session_id AND l.gap_id = b.gap_id
            AND l.start_ms >= b.start_ms AND l.end_ms <= b.end_ms GROUP BY ALL),
    top AS (SELECT session_id, gap_id, max(level_db) AS top_db FROM ins GROUP BY ALL),
    r AS (SELECT g.session_id, g.gap_id, g.before,
            CASE WHEN pk.start_ms IS NULL THEN g.start_ms ELSE greatest(g.start_ms, pk.start_ms - 150) END AS start_ms,
            CASE WHEN pk.start_ms IS NULL THEN g.end_ms ELSE least(g.end_ms, pk.end_ms + 150) END AS end_ms,
            CASE WHEN pk.start_ms IS NULL THEN 'silence' ELSE 'sound' END AS kind,
            round(coalesce(peak_db, top_db), 1) AS peak_db
          FROM gaps g LEFT JOIN pk USING (session_id, gap_id) LEFT JOIN top USING (session_id, gap_id))
    SELECT session_id, printf('G%04d', row_number() OVER (PARTITION BY session_id ORDER BY start_ms, end_ms, gap_id)) AS gap_id,
           before, start_ms, end_ms, kind, peak_db FROM r""",
)
def classify_gaps(spark, sf):
    levels = (
        fx.frames(spark, sf)
        .groupBy("session_id", (F.col("f") * 300).alias("start_ms"))
        .agg(F.max("level_db").alias("level_db"))
    )
    gaps = iv.find_gaps(fx.blocks(spark, sf)).drop("keep")
    return iv.classify_gaps(gaps, levels, hop_ms=300, burst_db=-20.0, min_burst_ms=600)


# --- speakers --------------------------------------------------------------


@query(
    "rank_speakers",
    "turns",
    """SELECT session_id, speaker, CAST(total_ms AS BIGINT) AS total_ms, 'S' || row_number() OVER (
          PARTITION BY session_id ORDER BY total_ms DESC, fs, ft, speaker) AS label
       FROM (SELECT session_id, speaker, sum(end_ms - start_ms) AS total_ms, min(start_ms) AS fs,
               arg_min(turn_idx, (start_ms, turn_idx)) AS ft FROM turns GROUP BY ALL)""",
)
def rank_speakers(spark, sf):
    return sp.rank_speakers(fx.turns(spark, sf))


@query(
    "apply_name_map",
    "cues",
    """SELECT session_id, idx, CASE speaker WHEN 'user' THEN 'Host' ELSE speaker END AS speaker FROM cues""",
)
def apply_name_map(spark, sf):
    rows = fx.cues(spark, sf).select("session_id", "idx", "speaker")
    mapping = rows.select("speaker").distinct().filter("speaker = 'user'").withColumn("name", F.lit("Host"))
    return sp.apply_name_map(rows, mapping)


@query(
    "speaker_switches",
    "turns",
    """SELECT session_id, count(*) FILTER (WHERE prev IS NOT NULL AND prev <> speaker) AS switches
       FROM (SELECT *, lag(speaker) OVER (PARTITION BY session_id ORDER BY turn_idx) AS prev FROM turns)
       GROUP BY session_id""",
)
def speaker_switches(spark, sf):
    return sp.speaker_switches(
        fx.turns(spark, sf), order=["turn_idx"], chunk=time_chunk("turn_idx", 4096)
    )


NEAREST = """
    (SELECT arg_min(t.speaker, (least(abs(2*t.start_ms - p.start_ms - p.end_ms),
                                     abs(2*t.end_ms - p.start_ms - p.end_ms)), t.turn_idx))
     FROM turns t WHERE t.session_id = p.session_id)"""


@query(
    "nearest_join",
    "cues turns",
    f"""SELECT p.session_id, p.idx,
         (SELECT min(least(abs(2*t.start_ms - p.start_ms - p.end_ms), abs(2*t.end_ms - p.start_ms - p.end_ms)))
          FROM turns t WHERE t.session_id = p.session_id) AS dist2, {NEAREST} AS speaker
        FROM cues p""",
)
def nearest_join(spark, sf):
    return sp.nearest_join(fx.cues(spark, sf), fx.turns(spark, sf)).drop("turn_idx")


BEST = """
    SELECT p.session_id, {key}, arg_min(t.speaker, (-(least(p.end_ms, t.end_ms) - greatest(p.start_ms, t.start_ms)), t.turn_idx)) AS matched,
           max(least(p.end_ms, t.end_ms) - greatest(p.start_ms, t.start_ms)) AS ov
    FROM {src} p JOIN turns t ON t.session_id = p.session_id AND p.start_ms < t.end_ms AND p.end_ms > t.start_ms
     AND p.end_ms > p.start_ms
    GROUP BY p.session_id, {key}"""


@query(
    "assign_by_max_overlap",
    "cues turns",
    f"""WITH best AS ({BEST.format(src="cues", key="p.idx")})
    SELECT p.session_id, p.idx, coalesce(b.matched, {NEAREST}, 'S1') AS speaker, coalesce(b.ov, 0) AS overlap_ms
    FROM cues p LEFT JOIN best b ON b.session_id = p.session_id AND b.idx = p.idx""",
)
def assign_by_max_overlap(spark, sf):
    cues = fx.cues(spark, sf).drop("text")
    return sp.assign_by_max_overlap(cues, fx.turns(spark, sf)).select(
        "session_id", "idx", "speaker", "overlap_ms"
    )


LABELLED = f"""
    best AS ({BEST.format(src="words", key="p.idx, p.pos")}),
    seeded AS (SELECT p.session_id, p.idx, p.pos, p.word, p.start_ms, p.end_ms,
        CASE WHEN row_number() OVER (PARTITION BY p.session_id ORDER BY p.start_ms, p.idx, p.pos) = 1
             THEN coalesce(b.matched, {NEAREST}, 'S1') ELSE b.matched END AS seed
      FROM words p LEFT JOIN best b ON b.session_id = p.session_id AND b.idx = p.idx AND b.pos = p.pos),
    labelled AS (SELECT * EXCLUDE (seed), last_value(seed IGNORE NULLS) OVER (PARTITION BY session_id
        ORDER BY start_ms, idx, pos ROWS UNBOUNDED PRECEDING) AS label FROM seeded)"""


@query(
    "label_words",
    "cues words turns",
    f"WITH {LABELLED} SELECT session_id, idx, pos, label FROM labelled",
)
def label_words(spark, sf):
    return sp.label_words(fx.words(spark, sf), fx.turns(spark, sf)).select(
        "session_id", "idx", "pos", "label"
    )


TO_CUES = """(SELECT min(c.idx) FROM cues c WHERE c.session_id = w.session_id
      AND (c.end_ms > w.start_ms OR (w.end_ms <= w.start_ms AND c.end_ms = w.start_ms)))"""


@query(
    "words_to_cues",
    "cues words",
    f"""SELECT * FROM (SELECT w.session_id, w.idx, w.pos, {TO_CUES} AS cue_idx FROM words w)
        WHERE cue_idx IS NOT NULL""",
)
def words_to_cues(spark, sf):
    return sp.words_to_cues(fx.words(spark, sf), fx.cues(spark, sf)).select(
        "session_id", "idx", "pos", "cue_idx"
    )


@query(
    "words_in_block",
    "cues words blocks",
    """SELECT w.session_id, b.block_id, count(*) AS n_words
       FROM words w JOIN blocks b ON b.session_id = w.session_id
        AND w.start_ms + w.end_ms >= 2*b.start_ms AND w.start_ms + w.end_ms < 2*b.end_ms
       GROUP BY w.session_id, b.block_id""",
)
def words_in_block(spark, sf):
    pairs = sp.words_in_block(
        fx.words(spark, sf), fx.blocks(spark, sf).select("session_id", "block_id", "start_ms", "end_ms")
    )
    return pairs.groupBy("session_id", F.col("r_block_id").alias("block_id")).agg(
        F.count("*").alias("n_words")
    )


@query("split_at_speaker_change")
def split_at_speaker_change(spark, sf):
    return sp.split_at_speaker_change(
        fx.cues(spark, sf), fx.turns(spark, sf), fx.words(spark, sf)
    )


@query(
    "insert_blocks",
    "cues",
    """SELECT session_id, printf('S%04d', row_number() OVER (PARTITION BY session_id ORDER BY idx)) AS block_id,
              start_ms, end_ms, 'Guest' AS speaker, trim(text) AS text, TRUE AS keep,
              CASE WHEN idx % 5 = 2 THEN '⚠ASR-artifact：同字元連續重複 6 次' ELSE '' END AS reason,
              idx % 5 = 2 AS asr_artifact, CASE WHEN idx % 5 = 2 THEN '同字元連續重複 6 次' ELSE '' END AS asr_artifact_reason
       FROM (SELECT * REPLACE (CASE WHEN idx % 5 = 2 THEN 'zzzzzz' || idx ELSE 'block ' || idx END AS text) FROM cues)""",
)
def insert_blocks(spark, sf):
    """Every fifth block is a run of one letter."""
    n = F.col("idx").cast("string")
    text = F.when(F.col("idx") % 5 == 2, F.concat(F.lit("zzzzzz"), n)).otherwise(F.concat(F.lit("block "), n))
    return sp.insert_blocks(fx.cues(spark, sf).withColumn("text", text), "Guest")
