"""Edit plan queries: differences, validation, units, output timeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueline import fixtures as fx
from cueline.fixtures import with_views
from cueline.functions import text as tx
from cueline.plans import editing as ed
from cueline.plans import layout as lo

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, views: str | None = None, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(views, sql) if views else sql
        return fn

    return register


RAW = {
    "old": "CASE WHEN idx % 5 = 0 THEN replace(text, ' le', '~~') ELSE text END",
    "new": "CASE WHEN idx % 4 = 0 THEN replace(text, 'th', '~~') ELSE text END",
}


def version(spark, sf, which: str):
    blocks = fx.blocks(spark, sf)
    step, mark = (5, " le") if which == "old" else (4, "th")
    raw = F.when(F.col("idx") % step == 0, F.replace("text", F.lit(mark), F.lit("~~"))).otherwise(
        F.col("text")
    )
    keep_rows = "idx % 9 <> 8" if which == "old" else "idx % 9 <> 7"
    rows = blocks.filter(keep_rows).select(
        "session_id", "idx", "block_id", F.col(f"keep_{which}").alias("keep"), raw.alias("raw"), "text"
    )
    cut = 3 if which == "old" else 4
    cuts = blocks.filter(F.col("idx") % cut == 0).select(
        "session_id", F.col("start_ms").alias("a_ms"), F.col("end_ms").alias("b_ms")
    )
    params = blocks.filter("idx < 3").select(
        "session_id",
        F.lit("config").alias("scope"),
        F.col("block_id").alias("name"),
        (F.col("session_id") % cut).cast("string").alias("value"),
    )
    return {"blocks": rows, "cuts": cuts, "params": params}


VERSIONS = f"""
    oldv AS (SELECT session_id, idx, block_id, keep_old AS keep, {RAW['old']} AS raw, text FROM blocks WHERE idx % 9 <> 8),
    newv AS (SELECT session_id, idx, block_id, keep_new AS keep, {RAW['new']} AS raw, text FROM blocks WHERE idx % 9 <> 7)"""
NS = "(len(string_split({}, '~~')) - 1) // 2"


@query(
    "plan_diff",
    "blocks",
    f"""WITH {VERSIONS},
    j AS (SELECT session_id, block_id, o.keep AS ok, n.keep AS nk, coalesce({NS.format('o.raw')}, 0) AS os, coalesce({NS.format('n.raw')}, 0) AS ns
          FROM oldv o FULL OUTER JOIN newv n USING (session_id, block_id)),
    co AS (SELECT session_id, start_ms AS a, end_ms AS b FROM blocks WHERE idx % 3 = 0),
    cn AS (SELECT session_id, start_ms AS a, end_ms AS b FROM blocks WHERE idx % 4 = 0)
    SELECT session_id, 'keep' AS kind, block_id AS item, ok::VARCHAR AS was, nk::VARCHAR AS now FROM j WHERE ok <> nk
    UNION ALL SELECT session_id, 'strikes', block_id, os::VARCHAR, ns::VARCHAR FROM j WHERE os <> ns
    UNION ALL SELECT session_id, 'only_one_side', block_id, (ok IS NOT NULL)::VARCHAR, (nk IS NOT NULL)::VARCHAR FROM j WHERE (ok IS NULL) <> (nk IS NULL)
    UNION ALL SELECT session_id, 'cut_removed', a || '-' || b, 'true', 'false' FROM (SELECT * FROM co EXCEPT SELECT * FROM cn)
    UNION ALL SELECT session_id, 'cut_added', a || '-' || b, 'false', 'true' FROM (SELECT * FROM cn EXCEPT SELECT * FROM co)
    UNION ALL SELECT session_id, 'param', 'config.' || block_id, (session_id % 3)::VARCHAR, (session_id % 4)::VARCHAR FROM blocks
      WHERE idx < 3 AND session_id % 3 <> session_id % 4""",
)
def plan_diff(spark, sf):
    return ed.plan_diff(version(spark, sf, "old"), version(spark, sf, "new"))


SPANS = """len(list_filter(range(1, ((len(string_split({0}, '~~')) - 1) // 2) * 2, 2),
    lambda i: length(regexp_replace(string_split({0}, '~~')[i + 1], '\\s+', '', 'g')) > 0))"""


@query("changed_blocks")
def changed_blocks(spark, sf):
    def decisions(which):
        rows = version(spark, sf, which)["blocks"]
        return rows.select("session_id", "block_id", "keep", tx.parse_strikes(F.col("raw"))["spans"].alias("spans"))

    return ed.changed_blocks(decisions("old"), decisions("new"))


@query(
    "changed_block_flips",
    "blocks",
    f"""WITH {VERSIONS}, j AS (SELECT n.session_id, n.block_id, n.keep, o.keep AS ok FROM newv n LEFT JOIN oldv o USING (session_id, block_id)),
    s AS (SELECT session_id, count(*) FILTER (ok IS NULL) > greatest(1.0, count(*) * 0.3) AS resegmented FROM j GROUP BY session_id)
    SELECT session_id, block_id, CASE WHEN ok IS NULL THEN '新增' WHEN keep THEN '改回保留' ELSE '剪掉' END AS change, resegmented
    FROM j JOIN s USING (session_id) WHERE CASE WHEN ok IS NULL THEN NOT resegmented AND keep ELSE ok <> keep END""",
)
def changed_flips(spark, sf):
    def decisions(which):
        none = F.array().cast("array<struct<a:int,b:int>>")
        return version(spark, sf, which)["blocks"].select("session_id", "block_id", "keep", none.alias("spans"))

    return ed.changed_blocks(decisions("old"), decisions("new"))


@query(
    "validate_plan",
    "blocks cues",
    f"""WITH {VERSIONS}, bl AS (SELECT session_id, block_id, CASE WHEN idx % 11 = 10 THEN 'X' || text ELSE text END AS text, CASE WHEN idx % 22 = 10 THEN 'voicing' ELSE 'speech' END AS kind FROM blocks WHERE idx % 13 <> 12),
    ga AS (SELECT session_id, printf('G%04d', idx) AS block_id FROM blocks WHERE idx % 4 = 0), ins AS (SELECT session_id, printf('S%04d', idx) AS block_id, text FROM blocks WHERE idx % 5 = 0),
    tr AS (SELECT session_id, string_agg(regexp_replace(text, '\\s+', '', 'g'), '' ORDER BY idx) AS flat FROM cues GROUP BY session_id),
    lg AS (SELECT session_id, 'L0001' AS block_id, substr(flat, 3) AS text FROM tr UNION ALL SELECT session_id, 'L0002', substr(flat, 3) || 'X' FROM tr),
    ab AS (SELECT session_id, block_id, text, kind FROM bl UNION ALL SELECT *, 'speech' FROM lg),
    pr AS (SELECT session_id, block_id, keep, CASE WHEN idx % 6 = 5 THEN substr(raw, 2) WHEN idx % 11 = 10 THEN 'X' || text ELSE text END AS raw FROM newv
      UNION ALL SELECT session_id, block_id, TRUE, text FROM lg
      UNION ALL SELECT session_id, printf('G%04d', idx), TRUE, 'silence' FROM blocks WHERE idx % 2 = 0
      UNION ALL SELECT session_id, printf('S%04d', idx), TRUE, CASE WHEN idx % 3 = 1 THEN 'other' ELSE text END FROM blocks WHERE idx % 5 <> 1)
    SELECT session_id, block_id, 'missing' AS problem FROM ab ANTI JOIN pr USING (session_id, block_id)
    UNION ALL SELECT session_id, block_id, 'extra' FROM pr ANTI JOIN ab USING (session_id, block_id) ANTI JOIN ga USING (session_id, block_id) ANTI JOIN ins USING (session_id, block_id)
    UNION ALL SELECT pr.session_id, pr.block_id, 'altered' FROM pr JOIN (SELECT session_id, block_id, text FROM ab UNION ALL FROM ins) x USING (session_id, block_id)
      WHERE regexp_replace(replace(pr.raw, '~~', ''), '\\s+', '', 'g') <> regexp_replace(x.text, '\\s+', '', 'g')
    UNION ALL SELECT pr.session_id, pr.block_id, 'not_in_transcript' FROM pr JOIN ab USING (session_id, block_id) JOIN tr ON tr.session_id = pr.session_id
      WHERE pr.keep AND kind = 'speech' AND regexp_replace(ab.text, '\\s+', '', 'g') <> '' AND NOT contains(tr.flat, regexp_replace(ab.text, '\\s+', '', 'g'))""",
)
def validate_plan(spark, sf):
    """Blocks of a cue and of a whole session, rows of gaps and inserts, and voices that are not speech."""
    cues, rows = fx.cues(spark, sf), fx.blocks(spark, sf)
    idx = F.col("idx")
    blocks = rows.filter("idx % 13 <> 12").select(
        "session_id",
        "block_id",
        F.when(idx % 11 == 10, F.concat(F.lit("X"), "text")).otherwise(F.col("text")).alias("text"),
        F.when(idx % 22 == 10, "voicing").otherwise("speech").alias("kind"),
    )
    said = F.array_sort(F.collect_list(F.struct("idx", F.regexp_replace("text", r"\s+", "").alias("t"))))
    whole = F.substring(F.array_join(F.transform(said, lambda x: x["t"]), ""), 3, 2**31 - 1)
    sessions = cues.groupBy("session_id").agg(whole.alias("text"))
    long = sessions.select("session_id", F.lit("L0001").alias("block_id"), "text").unionByName(
        sessions.select("session_id", F.lit("L0002").alias("block_id"), F.concat("text", F.lit("X")).alias("text"))
    )
    gap_id, insert_id = F.format_string("G%04d", idx), F.format_string("S%04d", idx)
    program = (
        version(spark, sf, "new")["blocks"]
        .select(
            "session_id",
            "block_id",
            "keep",
            F.when(idx % 6 == 5, F.substring("raw", 2, 2**31 - 1))
            .when(idx % 11 == 10, F.concat(F.lit("X"), "text"))
            .otherwise(F.col("text"))
            .alias("raw"),
        )
        .unionByName(long.select("session_id", "block_id", F.lit(True).alias("keep"), F.col("text").alias("raw")))
        .unionByName(
            rows.filter("idx % 2 = 0").select("session_id", gap_id.alias("block_id"), F.lit(True).alias("keep"), F.lit("silence").alias("raw"))
        )
        .unionByName(
            rows.filter("idx % 5 <> 1").select(
                "session_id", insert_id.alias("block_id"), F.lit(True).alias("keep"), F.when(idx % 3 == 1, "other").otherwise(F.col("text")).alias("raw")
            )
        )
    )
    return ed.validate_plan(
        blocks.unionByName(long.withColumn("kind", F.lit("speech"))),
        program,
        cues,
        gaps=rows.filter("idx % 4 = 0").select("session_id", gap_id.alias("block_id")),
        inserts=rows.filter("idx % 5 = 0").select("session_id", insert_id.alias("block_id"), "text"),
    )


@query(
    "apply_marks",
    "blocks",
    """WITH g AS (SELECT session_id, printf('G%04d', row_number() OVER (PARTITION BY session_id ORDER BY idx)) AS gap_id, gs AS start_ms, start_ms AS end_ms FROM (
          SELECT *, lag(end_ms, 1, 0) OVER (PARTITION BY session_id ORDER BY idx) AS gs FROM blocks) WHERE start_ms - gs >= 2000),
    pr AS (SELECT session_id, idx, block_id, keep_new AS keep FROM blocks WHERE idx % 9 <> 7 UNION ALL SELECT session_id, 10000, 'G0001', session_id % 2 = 0 FROM (SELECT DISTINCT session_id FROM blocks))
    SELECT b.session_id, 'block' AS kind, b.block_id, b.start_ms, b.end_ms, pr.keep FROM blocks b JOIN pr USING (session_id, block_id)
    UNION ALL SELECT g.session_id, 'gap', g.gap_id, g.start_ms, g.end_ms, coalesce(pr.keep, FALSE) FROM g LEFT JOIN pr ON pr.session_id = g.session_id AND pr.block_id = g.gap_id""",
)
def apply_marks(spark, sf):
    from cueline.operators.intervals import find_gaps

    blocks = fx.blocks(spark, sf)
    rows = blocks.filter("idx % 9 <> 7").select(
        "session_id", F.col("idx").alias("seq"), "block_id", F.col("keep_new").alias("keep")
    )
    ticks = blocks.select("session_id").distinct().select(
        "session_id",
        F.lit(10000).cast("bigint").alias("seq"),
        F.lit("G0001").alias("block_id"),
        (F.col("session_id") % 2 == 0).alias("keep"),
    )
    gaps = find_gaps(blocks).select("session_id", "gap_id", "start_ms", "end_ms")
    return ed.apply_marks(rows.unionByName(ticks), blocks, gaps)


@query(
    "anchor_structure",
    "blocks",
    """WITH l AS (SELECT session_id, idx AS seq, CASE WHEN idx % 3 = 1 THEN start_ms END AS t_ms FROM blocks)
       SELECT session_id, seq, t_ms, first_value(t_ms IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS anchor_ms FROM l""",
)
def anchor_structure(spark, sf):
    lines = fx.blocks(spark, sf).select(
        "session_id", F.col("idx").alias("seq"), F.when(F.col("idx") % 3 == 1, F.col("start_ms")).alias("t_ms")
    )
    return lo.anchor_structure(lines)


PROGRAM = """pg AS (SELECT session_id, idx AS seq, CASE WHEN idx % 6 = 5 THEN 'music' WHEN idx % 8 = 7 THEN 'insert' ELSE 'block' END AS kind,
     keep_old AS keep, idx % 10 < 3 AS clip, start_ms, end_ms, block_id FROM blocks)"""


def program(spark, sf):
    i = F.col("idx")
    return fx.blocks(spark, sf).select(
        "session_id",
        i.alias("seq"),
        F.when(i % 6 == 5, "music").when(i % 8 == 7, "insert").otherwise("block").alias("kind"),
        F.col("keep_old").alias("keep"),
        (i % 10 < 3).alias("clip"),
        "start_ms",
        "end_ms",
        "block_id",
    )


@query(
    "join_units",
    "blocks",
    f"""WITH {PROGRAM}, l AS (SELECT *, lag(kind) OVER w AS pk, lag(end_ms) OVER w AS pe, lag(clip) OVER w AS pc FROM pg
          WHERE kind <> 'block' OR keep WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
    n AS (SELECT *, sum(CASE WHEN pk = 'block' AND pc = clip AND start_ms - pe >= 0 AND start_ms - pe < 2000 THEN 0 ELSE 1 END)
            OVER (PARTITION BY session_id ORDER BY seq) AS unit FROM l WHERE kind = 'block')
    SELECT session_id, CAST(unit AS BIGINT) AS unit, arg_min(start_ms, seq) AS start_ms, arg_max(end_ms, seq) AS end_ms, any_value(clip) AS clip,
      min(seq) AS first_seq, count(*) AS blocks FROM n GROUP BY session_id, unit""",
)
def join_units(spark, sf):
    return lo.join_units(program(spark, sf))


SEGS = """sg AS (SELECT session_id, idx AS seq, CASE WHEN idx % 5 = 4 THEN 'silence' WHEN idx % 7 = 6 THEN 'insert' ELSE 'speech' END AS kind,
     start_ms, end_ms, idx % 11 = 3 AS faded FROM blocks),
    du AS (SELECT *, CASE WHEN kind = 'speech' THEN (end_ms - start_ms) / 1.25 ELSE (end_ms - start_ms)::DOUBLE END AS dur FROM sg),
    lg AS (SELECT *, lag(kind) OVER w AS pk, lag(dur) OVER w AS pd, lag(faded) OVER w AS pf FROM du WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
    se AS (SELECT *, CASE WHEN pk IS NULL THEN 0.0 ELSE greatest(5.0, least(CASE WHEN kind IN ('silence', 'insert') OR pk IN ('silence', 'insert') OR faded OR pf
             THEN 10.0 ELSE 40.0 END, pd / 2 - 5, dur / 2 - 5)) END AS seam FROM lg),
    tl AS (SELECT *, greatest(0.0, coalesce(sum(dur) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
             - sum(seam) OVER (PARTITION BY session_id ORDER BY seq)) AS dst FROM se)"""


def segments(spark, sf):
    i = F.col("idx")
    return fx.blocks(spark, sf).select(
        "session_id",
        i.alias("seq"),
        F.when(i % 5 == 4, "silence").when(i % 7 == 6, "insert").otherwise("speech").alias("kind"),
        "start_ms",
        "end_ms",
        (i % 11 == 3).alias("faded"),
    )


@query("seam_overlap", "blocks", f"WITH {SEGS} SELECT session_id, seq, dur AS dur_ms, seam AS seam_ms FROM se")
def seam_overlap(spark, sf):
    return lo.seam_overlap(segments(spark, sf), tempo=1.25).select("session_id", "seq", "dur_ms", "seam_ms")


@query(
    "output_timeline",
    "blocks",
    f"WITH {SEGS} SELECT session_id, seq, kind, round(dst, 6) AS dst_start_ms FROM tl",
)
def output_timeline(spark, sf):
    out = lo.output_timeline(segments(spark, sf), tempo=1.25)
    return out.select("session_id", "seq", "kind", F.round("dst_start_ms", 6).alias("dst_start_ms"))


@query(
    "chapters",
    "blocks",
    f"""WITH {SEGS} SELECT b.session_id, b.idx AS seq, b.block_id AS title,
        (SELECT round(arg_min(t.dst, t.seq), 6) FROM tl t WHERE t.session_id = b.session_id AND t.seq >= b.idx AND t.seq % 3 <> 0) AS at_ms
        FROM blocks b WHERE idx % 3 = 0 AND EXISTS (SELECT 1 FROM tl t WHERE t.session_id = b.session_id AND t.seq >= b.idx AND t.seq % 3 <> 0)""",
)
def chapters(spark, sf):
    headings = fx.blocks(spark, sf).filter("idx % 3 = 0").select(
        "session_id", F.col("idx").alias("seq"), F.col("block_id").alias("title")
    )
    timeline = lo.output_timeline(segments(spark, sf), tempo=1.25).filter("seq % 3 <> 0")
    out = lo.chapters(headings, timeline)
    return out.withColumn("at_ms", F.round("at_ms", 6))


MUSIC = """un AS (SELECT session_id, idx AS seq, CASE WHEN idx % 4 = 0 THEN 'music' WHEN idx % 4 = 3 THEN 'insert' ELSE 'speech' END AS kind,
     end_ms - start_ms AS dur_ms, 1000 + start_ms % 4000 AS lead_ms, end_ms % 5000 AS tail_ms FROM blocks),
    ov AS (SELECT *, EXISTS (SELECT 1 FROM un v WHERE v.session_id = un.session_id AND v.seq < un.seq AND v.kind = 'speech') AS hp,
             EXISTS (SELECT 1 FROM un v WHERE v.session_id = un.session_id AND v.seq > un.seq AND v.kind = 'speech') AS hn FROM un WHERE kind = 'music'),
    og AS (SELECT session_id, seq, dur_ms, CASE WHEN hp THEN least(lead_ms, 3000) ELSE 0 END AS lead_ms, CASE WHEN hn THEN tail_ms ELSE 0 END AS tail_ms,
             hp AS has_prev, hn AS has_next FROM ov)"""


def units(spark, sf):
    i = F.col("idx")
    return fx.blocks(spark, sf).select(
        "session_id",
        i.alias("seq"),
        F.when(i % 4 == 0, "music").when(i % 4 == 3, "insert").otherwise("speech").alias("kind"),
        (F.col("end_ms") - F.col("start_ms")).alias("dur_ms"),
        (F.col("start_ms") % 4000 + 1000).alias("lead_ms"),
        (F.col("end_ms") % 5000).alias("tail_ms"),
    )


@query(
    "overlay_gaps",
    "blocks",
    f"""WITH {MUSIC} SELECT *, CASE WHEN has_next THEN dur_ms - lead_ms - tail_ms END AS gap_ms,
        coalesce(CASE WHEN has_next THEN dur_ms - lead_ms - tail_ms END < 100, FALSE) AS is_error FROM og""",
)
def overlay_gaps(spark, sf):
    return lo.overlay_gaps(units(spark, sf))


@query(
    "envelope_points",
    "blocks",
    f"""WITH {MUSIC}, s AS (SELECT session_id, seq, dur_ms / 1000.0::DOUBLE AS d, 1.0::DOUBLE AS fi, 1.5::DOUBLE AS fo, lead_ms / 1000.0::DOUBLE AS l, tail_ms / 1000.0::DOUBLE AS t, has_prev, has_next FROM og),
    p AS (SELECT session_id, seq, d, list_concat([0.0::DOUBLE], CASE WHEN has_prev THEN [least(fi, greatest(l, 0.1)), l, l + 1.0] ELSE [fi] END,
           CASE WHEN has_next THEN [d - t - 1.0, d - t, d - t + least(fo, greatest(t, 0.1))] ELSE [d - fo] END, [d]) AS ts FROM s),
    e AS (SELECT session_id, seq, d, unnest(ts) AS x, unnest(range(len(ts))) AS i FROM p),
    m AS (SELECT session_id, seq, i, least(greatest(0, max(x) OVER (PARTITION BY session_id, seq ORDER BY i)), d) AS x FROM e)
    SELECT session_id, seq, round(max(x), 6) AS last_t, round(sum(x) FILTER (i = 1), 6) AS first_t FROM m GROUP BY session_id, seq""",
)
def envelope_points(spark, sf):
    music = lo.overlay_gaps(units(spark, sf)).select(
        "session_id",
        "seq",
        (F.col("dur_ms") / 1000.0).alias("dur"),
        F.lit(1.0).alias("fadein"),
        F.lit(1.5).alias("fadeout"),
        (F.col("lead_ms") / 1000.0).alias("lead"),
        (F.col("tail_ms") / 1000.0).alias("tail"),
        "has_prev",
        "has_next",
    )
    points = lo.envelope_points(music)
    return points.select(
        "session_id",
        "seq",
        F.round(F.element_at("points", -1)["t"], 6).alias("last_t"),
        F.round(F.get("points", 1)["t"], 6).alias("first_t"),
    )


@query(
    "reference_window",
    "blocks",
    f"""WITH {SEGS}, c AS (SELECT *, coalesce(sum(CASE WHEN kind = 'speech' THEN end_ms - start_ms ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at FROM sg)
    SELECT i.session_id, i.seq, 'before' AS side, s.end_ms - (least(i.at, s.at + s.end_ms - s.start_ms) - greatest(i.at - 15000, s.at)) AS start_ms, s.end_ms
    FROM c i JOIN c s ON s.session_id = i.session_id AND s.kind = 'speech' AND s.at < i.at AND s.at + s.end_ms - s.start_ms > i.at - 15000 WHERE i.kind = 'insert'
    UNION ALL SELECT i.session_id, i.seq, 'after', s.start_ms, s.start_ms + (least(i.at + 15000, s.at + s.end_ms - s.start_ms) - greatest(i.at, s.at))
    FROM c i JOIN c s ON s.session_id = i.session_id AND s.kind = 'speech' AND s.at < i.at + 15000 AND s.at + s.end_ms - s.start_ms > i.at WHERE i.kind = 'insert'""",
)
def reference_window(spark, sf):
    return lo.reference_window(segments(spark, sf))


@query("strikes_to_time")
def strikes_to_time(spark, sf):
    blocks = fx.blocks(spark, sf)
    marked = F.concat(F.lit("~~"), F.substring("text", 1, 6), F.lit("~~"), F.substring("text", 7, 2**31 - 1))
    strikes = blocks.select(
        "session_id", "block_id", F.explode(tx.parse_strikes(marked)["spans"]).alias("s")
    ).select("session_id", "block_id", "s.a", "s.b")
    return lo.strikes_to_time(blocks, strikes, fx.words(spark, sf))


@query(
    "extend_edges",
    "blocks words",
    r"""WITH u AS (SELECT session_id, idx AS unit, start_ms, end_ms, regexp_replace(text, '\s+', '', 'g') AS flat FROM blocks),
    sp AS (SELECT session_id, start_ms, end_ms, pos, regexp_replace(word, '\s+', '', 'g') AS w FROM words),
    f AS (SELECT u.session_id, u.unit, arg_min(sp.start_ms, (sp.start_ms, sp.end_ms, sp.pos)) AS h FROM u JOIN sp ON sp.session_id = u.session_id
       AND sp.end_ms > u.start_ms - 300 AND sp.start_ms < u.end_ms + 800 AND w <> '' AND flat <> '' AND left(w, 1) = left(flat, 1) GROUP BY ALL),
    l AS (SELECT u.session_id, u.unit, arg_max(sp.end_ms, (sp.start_ms, sp.end_ms, sp.pos)) AS h FROM u JOIN sp ON sp.session_id = u.session_id
       AND sp.end_ms > u.start_ms - 300 AND sp.start_ms < u.end_ms + 800 AND w <> '' AND flat <> '' AND right(w, 1) = right(flat, 1) GROUP BY ALL)
    SELECT u.session_id, u.unit, CASE WHEN f.h >= u.start_ms - 800 AND f.h < u.start_ms THEN f.h ELSE u.start_ms END AS start_ms,
      CASE WHEN l.h > u.end_ms AND l.h <= u.end_ms + 800 THEN l.h ELSE u.end_ms END AS end_ms,
      coalesce(f.h >= u.start_ms - 800 AND f.h < u.start_ms, FALSE) AS start_exact, coalesce(l.h > u.end_ms AND l.h <= u.end_ms + 800, FALSE) AS end_exact
    FROM u LEFT JOIN f USING (session_id, unit) LEFT JOIN l USING (session_id, unit)""",
)
def extend_edges(spark, sf):
    b = fx.blocks(spark, sf)
    units_ = b.select(
        "session_id",
        F.col("idx").alias("unit"),
        "start_ms",
        "end_ms",
        F.col("start_ms").alias("first_start_ms"),
        F.col("end_ms").alias("first_end_ms"),
        F.col("text").alias("first_text"),
        F.col("start_ms").alias("last_start_ms"),
        F.col("end_ms").alias("last_end_ms"),
        F.col("text").alias("last_text"),
    )
    return lo.extend_edges(units_, fx.words(spark, sf))


@query(
    "clamp_monotonic",
    None,
    """WITH a AS (SELECT label AS session_id, vec_id, CASE WHEN vec_id % 6 <> 0 THEN vec_id % 40 END AS deck_page, 'f' || vec_id AS file, (vec_id * 37) % 50 AS line FROM embeddings)
    SELECT session_id, file, max(line) OVER (PARTITION BY session_id ORDER BY deck_page, file ROWS UNBOUNDED PRECEDING) AS line,
      max(line) OVER (PARTITION BY session_id ORDER BY deck_page, file ROWS UNBOUNDED PRECEDING) > line AS clamped FROM a WHERE deck_page IS NOT NULL
    UNION ALL SELECT session_id, file, line, FALSE FROM a WHERE deck_page IS NULL""",
)
def clamp_monotonic(spark, sf):
    n = F.col("vec_id")
    anchors = fx.table(spark, sf, "embeddings").select(
        F.col("label").alias("session_id"),
        F.when(n % 6 != 0, n % 40).alias("deck_page"),
        F.concat(F.lit("f"), n.cast("string")).alias("file"),
        (n * 37 % 50).alias("line"),
    )
    return lo.clamp_monotonic(anchors).select("session_id", "file", "line", "clamped")


@query(
    "scope_state",
    "blocks",
    f"""WITH {PROGRAM} SELECT session_id, seq, coalesce(last_value(CASE WHEN kind = 'insert' THEN block_id WHEN kind = 'music' THEN '' END IGNORE NULLS)
        OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING), '') AS scope FROM pg""",
)
def scope_state(spark, sf):
    """The insert each plan row belongs to; a music row ends the scope."""
    from cueline.operators.scan import nearest_value, row_chunk, scan

    mark = F.when(F.col("kind") == "insert", F.col("block_id")).when(F.col("kind") == "music", "")
    out = scan(
        program(spark, sf), "session_id", ["seq"], row_chunk("seq"), scope=nearest_value(mark, inclusive=True)
    )
    return out.select("session_id", "seq", F.coalesce("scope", F.lit("")).alias("scope"))
