"""Queries of the order-dependent operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueline import fixtures as fx
from cueline.catalog.text import mixed_cues
from cueline.catalog.tracks import NOISE, frames_once
from cueline.fixtures import with_views
from cueline.functions import constants as k
from cueline.functions import text as tx
from cueline.operators import figures as fg
from cueline.operators import folds as fo
from cueline.operators import monotone as mo
from cueline.operators import speakers as sp
from cueline.operators.tracks import noise_floor
from cueline.session import cut_lineage

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, views: str | None = None, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(views, sql) if views else sql
        return fn

    return register


#: The open segment handed from row to row: ``r`` has n, hard, soft, hi, lo.
GREEDY = """seg(session_id, n, op) AS (SELECT session_id, n, n FROM r WHERE n = 1 UNION ALL
      SELECT r.session_id, r.n, CASE WHEN r.hard OR (r.soft AND r.hi - o.lo {cmp} {cap}) THEN r.n ELSE seg.op END
      FROM seg JOIN r ON r.session_id = seg.session_id AND r.n = seg.n + 1 JOIN r o ON o.session_id = seg.session_id AND o.n = seg.op)"""


def ordered_rows(fields: str) -> str:
    return f"""r AS (SELECT session_id, row_number() OVER w AS n, text, speaker, idx, start_ms, end_ms, {fields} FROM cues
      WINDOW w AS (PARTITION BY session_id ORDER BY idx))"""


@query(
    "build_blocks",
    "cues",
    f"""WITH RECURSIVE {ordered_rows('''coalesce(start_ms - lag(end_ms) OVER w >= 3000, TRUE) AS hard, TRUE AS soft, end_ms AS hi, start_ms AS lo''')},
    {GREEDY.format(cmp='>', cap=45000)}
    SELECT session_id, printf('B%04d', row_number() OVER (PARTITION BY session_id ORDER BY op)) AS block_id, start_ms, end_ms, text, cue_idx FROM (
      SELECT r.session_id, op, min(r.start_ms) AS start_ms, arg_max(r.end_ms, r.n) AS end_ms, string_agg(r.text, '' ORDER BY r.n) AS text,
        string_agg(r.idx::VARCHAR, ',' ORDER BY r.n) AS cue_idx FROM seg JOIN r USING (session_id, n) GROUP BY r.session_id, op)""",
)
def build_blocks(spark, sf):
    """All cues as one speaker's, so that blocks run into their length limit."""
    cues = fx.cues(spark, sf).withColumn("speaker", F.lit("S1"))
    blocks = fo.build_blocks(cues, 3000, 45_000)
    return blocks.select(
        "session_id", "block_id", "start_ms", "end_ms", "text", F.array_join("cue_idx", ",").alias("cue_idx")
    )


@query(
    "build_blocks_unjoined",
    "cues",
    """SELECT session_id, printf('B%04d', row_number() OVER (PARTITION BY session_id ORDER BY idx)) AS block_id, start_ms, end_ms, speaker, text FROM cues""",
)
def build_blocks_unjoined(spark, sf):
    return fo.build_blocks(fx.cues(spark, sf)).drop("cue_idx", "keep")


_JOIN = f"CASE WHEN regexp_matches(text, '{k.PARAGRAPH_JOINER}') THEN 0 ELSE 1 END"


@query(
    "paragraphs",
    "cues",
    f"""WITH RECURSIVE {ordered_rows(f'''coalesce(start_ms - lag(end_ms) OVER w >= 2500, TRUE) AS hard, TRUE AS soft,
        sum(length(text) + {_JOIN}) OVER w - length(text) - {_JOIN} AS hi, sum(length(text) + {_JOIN}) OVER w - length(text) AS lo, {_JOIN} AS sp''')},
    {GREEDY.format(cmp='>=', cap=700)}
    SELECT r.session_id, op AS segment, min(r.start_ms) AS start_ms, arg_max(r.end_ms, r.n) AS end_ms,
      string_agg(CASE WHEN r.n = op OR sp = 0 THEN text ELSE ' ' || text END, '' ORDER BY r.n) AS text FROM seg JOIN r USING (session_id, n) GROUP BY r.session_id, op""",
)
def paragraphs(spark, sf):
    return fo.paragraphs(fx.cues(spark, sf), max_chars=700)


_VIS = r"length(regexp_replace(text, '\s+', '', 'g'))"


@query(
    "notes_paragraphs",
    "cues",
    f"""WITH RECURSIVE {ordered_rows(f'''FALSE AS hard, length(lag(text) OVER w) > 0 AND contains('{k.PARAGRAPH_END}', right(lag(text) OVER w, 1)) AS soft,
        sum({_VIS}) OVER w - {_VIS} AS hi, sum({_VIS}) OVER w - {_VIS} AS lo''')},
    {GREEDY.format(cmp='>=', cap=600)}
    SELECT r.session_id, op AS segment, min(r.start_ms) AS start_ms, arg_max(r.end_ms, r.n) AS end_ms, string_agg(text, ' ' ORDER BY r.n) AS text
    FROM seg JOIN r USING (session_id, n) GROUP BY r.session_id, op""",
)
def notes_paragraphs(spark, sf):
    return fo.notes_paragraphs(fx.cues(spark, sf), min_chars=600, separator=" ")


@query(
    "merge_sentences",
    "cues",
    f"""WITH RECURSIVE {ordered_rows('''lag(text) OVER w IS NULL OR contains(lag(text) OVER w, 'que') AS hard, TRUE AS soft,
        sum(length(text) + 1) OVER w - length(text) - 1 AS hi, sum(length(text) + 1) OVER w - length(text) AS lo''').replace('FROM cues', "FROM (SELECT * REPLACE (CASE WHEN contains(text, 'que') THEN text ELSE text || 'x' END AS text) FROM cues)")},
    {GREEDY.format(cmp='>=', cap=900)},
    s AS (SELECT r.session_id, op AS segment, min(r.start_ms) AS start_ms, regexp_replace(string_agg(text, ' ' ORDER BY r.n), '^\\s+|\\s+$', '', 'g') AS text FROM seg JOIN r USING (session_id, n) GROUP BY r.session_id, op)
    SELECT session_id, segment, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY session_id ORDER BY segment), start_ms + 4000) AS end_ms, text FROM s""",
)
def merge_sentences(spark, sf):
    """Texts with ``que`` keep their closing full stop, the others lose it to a letter."""
    text = F.when(F.contains("text", F.lit("que")), F.col("text")).otherwise(F.concat("text", F.lit("x")))
    return fo.merge_sentences(fx.cues(spark, sf).withColumn("text", text), max_chars=900)


@query("merge_sentence_rows")
def merge_sentence_rows(spark, sf):
    rows = fx.turns(spark, sf).select(
        "session_id",
        F.col("speaker").alias("owner"),
        F.col("turn_idx").alias("row_id"),
        "start_ms",
        (F.col("start_ms") + F.col("turn_idx") % 700 + 200).alias("end_ms"),
        F.when(F.col("turn_idx") % 11 == 0, "voicing").otherwise("speech").alias("kind"),
        F.concat(F.lit("t"), F.col("turn_idx").cast("string")).alias("text"),
        F.format_string("B%04d", F.col("turn_idx") % 50).alias("src"),
        F.lit("").alias("reason"),
    )
    return fo.merge_sentence_rows(rows, gap_ms=2500, max_block_ms=9000)


def _cue_words(spark, sf):
    words = fx.words(spark, sf).withColumn("cue_idx", F.col("idx"))
    # a real pause after every ninth word
    late = F.floor(F.col("pos") / 9) * 600
    return words.withColumn("start_ms", F.col("start_ms") + late).withColumn("end_ms", F.col("end_ms") + late)


@query("split_phrases")
def split_phrases(spark, sf):
    return fo.split_phrases(_cue_words(spark, sf), fx.cues(spark, sf), max_ms=1200)


@query(
    "split_phrases_by_mark_and_pause",
    "cues words",
    r"""WITH w AS (SELECT session_id, idx AS cue_idx, pos, word, start_ms + pos // 9 * 600 AS start_ms, end_ms + pos // 9 * 600 AS end_ms FROM words),
    c AS (SELECT *, CASE WHEN lag(pos) OVER x IS NULL THEN 0 WHEN lag(word) OVER x = '' OR contains('。?!…,、;:', right(lag(word) OVER x, 1)) OR start_ms - lag(end_ms) OVER x >= 500 THEN 1 ELSE 0 END AS b
          FROM w WINDOW x AS (PARTITION BY session_id, cue_idx ORDER BY start_ms, end_ms, pos)),
    p AS (SELECT *, sum(b) OVER (PARTITION BY session_id, cue_idx ORDER BY start_ms, end_ms, pos) AS g FROM c),
    q AS (SELECT session_id, cue_idx, g, arg_min(start_ms, (start_ms, end_ms, pos)) AS a, arg_max(end_ms, (start_ms, end_ms, pos)) AS z, count(*) AS n FROM p GROUP BY ALL),
    m AS (SELECT *, sum((g > 0 AND z > a)::INT) OVER (PARTITION BY session_id, cue_idx ORDER BY g) AS h FROM q),
    s AS (SELECT session_id, cue_idx, h, arg_min(a, g) AS a, arg_max(z, g) AS z, sum(n) AS n FROM m GROUP BY ALL),
    t AS (SELECT *, CASE WHEN h = 0 AND z - a <= 0 THEN 1 ELSE h END AS h2 FROM s)
    SELECT session_id, cue_idx, CAST(row_number() OVER (PARTITION BY session_id, cue_idx ORDER BY min(h)) - 1 AS INT) AS phrase, arg_min(a, h) AS start_ms, arg_max(z, h) AS end_ms FROM t GROUP BY session_id, cue_idx, h2""",
)
def split_phrases_simple(spark, sf):
    return fo.split_phrases(_cue_words(spark, sf), fx.cues(spark, sf)).drop("text")


@query(
    "join_words",
    "cues",
    """WITH w AS (SELECT session_id, idx, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM cues),
    p AS (SELECT *, lag(w) OVER (PARTITION BY session_id, idx ORDER BY i) AS p FROM w)
    SELECT session_id, idx, string_agg(CASE WHEN regexp_matches(p, '[A-Za-z0-9]$') AND regexp_matches(w, '^[A-Za-z0-9]') THEN ' ' ELSE '' END || w, '' ORDER BY i) AS text
    FROM p GROUP BY session_id, idx""",
)
def join_words(spark, sf):
    """Every text is put together again from its words; a space stays between two plain edges."""
    return fx.cues(spark, sf).select(
        "session_id", "idx", sp.joined_text(F.split("text", " "), F.col("text")).alias("text")
    )


@query("resegment")
def resegment(spark, sf):
    return fo.resegment(fx.cues(spark, sf), fx.words(spark, sf), max_ms=3000)


def _phrases(spark, sf):
    return fx.cues(spark, sf).select(
        "session_id",
        F.col("idx").alias("phrase_id"),
        (F.floor(F.col("idx") * 150)).cast("bigint").alias("start_ms"),
        (F.floor(F.col("idx") * 150) + 700 + F.col("start_ms") % 300).cast("bigint").alias("end_ms"),
    )


#: Frames of every phrase with the loudest tracks, and the owner after each frame.
OWNERS = f"""ph AS (SELECT session_id, idx AS phrase_id, greatest(0, round(idx * 150 / 10.0))::BIGINT AS fa, round((idx * 150 + 700 + start_ms % 300) / 10.0)::BIGINT AS fb,
      (idx * 150)::BIGINT AS ps, (idx * 150 + 700 + start_ms % 300)::BIGINT AS pe FROM cues),
    ce AS (SELECT p.session_id, phrase_id, f.f, f.track, f.level_db FROM ph p JOIN frames f ON f.session_id = p.session_id AND f.f >= fa AND f.f < fb),
    ra AS (SELECT session_id, phrase_id, f, count(*) AS w, list(ce.track ORDER BY level_db DESC, ce.track)[1] AS best, list(level_db ORDER BY level_db DESC)[1] AS top,
        list(level_db ORDER BY level_db DESC)[2] AS sec, bool_and(level_db < coalesce({{floor}}, '-infinity'::DOUBLE)) AS quiet, map(list(ce.track), list(level_db)) AS lv
      FROM ce LEFT JOIN {{noise}} n USING (session_id, track) GROUP BY session_id, phrase_id, f HAVING count(*) > 1),
    fr AS (SELECT *, row_number() OVER (PARTITION BY session_id, phrase_id ORDER BY f) - 1 AS i, count(*) OVER (PARTITION BY session_id, phrase_id) AS n,
        min(f) OVER (PARTITION BY session_id, phrase_id) AS f0 FROM (SELECT * FROM ra QUALIFY w = max(w) OVER (PARTITION BY session_id, phrase_id))),
    st(session_id, phrase_id, i, owner, began, rival, rb) AS (SELECT session_id, phrase_id, -1::BIGINT, NULL::VARCHAR, 0::BIGINT, NULL::VARCHAR, 0::BIGINT FROM fr WHERE i = 0
      UNION ALL SELECT fr.session_id, fr.phrase_id, fr.i, CASE WHEN est THEN claim ELSE owner END, CASE WHEN est THEN since ELSE began END, CASE WHEN est THEN NULL ELSE claim END, since
      FROM st JOIN fr ON fr.session_id = st.session_id AND fr.phrase_id = st.phrase_id AND fr.i = st.i + 1,
        LATERAL (SELECT CASE WHEN best IS DISTINCT FROM owner AND NOT (quiet AND top - sec < {k.FLOOR_BYPASS_LEAD_DB}) AND top - CASE WHEN owner IS NULL THEN sec ELSE lv[owner] END >= 3.0 THEN best END AS claim) x,
        LATERAL (SELECT CASE WHEN claim IS NOT NULL AND claim = rival THEN rb ELSE fr.i END AS since) y,
        LATERAL (SELECT claim IS NOT NULL AND (fr.i - since + 1) * 0.01 >= least(CASE WHEN owner IS NULL THEN 0.06 ELSE 0.05 END, greatest(0.02, 0.006 * n)) - 1e-9 AS est) z),
    ow AS (SELECT session_id, phrase_id, began, max_by(owner, i) AS owner FROM st WHERE i >= 0 GROUP BY ALL),
    sp AS (SELECT *, lead(began) OVER (PARTITION BY session_id, phrase_id ORDER BY began) AS stop, row_number() OVER (PARTITION BY session_id, phrase_id ORDER BY began) - 1 AS run FROM ow),
    rf AS (SELECT sp.session_id, sp.phrase_id, run::INT AS run, (any_value(f0) + began) * 10 AS start_ms, (any_value(f0) + coalesce(stop, any_value(n))) * 10 AS end_ms, owner,
        CASE WHEN owner IS NULL THEN CASE WHEN avg(quiet::INT) >= 0.5 THEN 'floor_gated' WHEN bool_or(NOT quiet AND top - sec >= 3.0) THEN 'unstable' ELSE 'below_margin' END END AS cause
      FROM sp JOIN fr ON fr.session_id = sp.session_id AND fr.phrase_id = sp.phrase_id AND fr.i >= began AND fr.i < coalesce(stop, n) GROUP BY sp.session_id, sp.phrase_id, run, began, stop, owner),
    ru AS (SELECT * FROM rf UNION ALL SELECT session_id, phrase_id, 0, ps, pe, NULL, 'below_margin' FROM ph
      WHERE NOT EXISTS (SELECT 1 FROM rf WHERE rf.session_id = ph.session_id AND rf.phrase_id = ph.phrase_id))"""


@query(
    "owner_runs",
    "cues frames",
    f"WITH RECURSIVE {NOISE}, {OWNERS.format(floor='n.noise_db - 20.0', noise='noise')} SELECT session_id, phrase_id, run, start_ms, end_ms, owner, cause FROM ru",
)
def owner_runs(spark, sf):
    frames = frames_once(spark, sf)
    floors = noise_floor(frames, margin_db=-20.0).select("session_id", "track", "floor_db")
    return fo.owner_runs(_phrases(spark, sf), frames, floors, stable_ms=60, switch_ms=50)


def _owner_parts(spark, sf):
    frames = frames_once(spark, sf)
    phrases = _phrases(spark, sf)
    runs = cut_lineage(fo.owner_runs(phrases, frames, None, stable_ms=60, switch_ms=50))
    n = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("pos")
    words = phrases.select("session_id", "phrase_id", "start_ms", n).select(
        "session_id",
        "phrase_id",
        F.col("pos").cast("bigint").alias("pos"),
        F.concat(F.lit("w"), F.col("pos").cast("string")).alias("word"),
        (F.col("start_ms") + F.col("pos") * 120).alias("start_ms"),
        (F.col("start_ms") + F.col("pos") * 120 + 100).alias("end_ms"),
    )
    return fo.split_phrase_by_owner(words, runs)


#: Six words of 100 ms in every phrase, cut where owners change: ``pa``.
PARTS = f"""{OWNERS.format(floor='n.q', noise='(SELECT NULL::BIGINT AS session_id, NULL::VARCHAR AS track, NULL::DOUBLE AS q)')},
    wo AS (SELECT session_id, idx AS phrase_id, i, idx * 150 + (i - 1) * 120 AS a, idx * 150 + (i - 1) * 120 + 100 AS b FROM cues, range(1, 7) t(i)
      SEMI JOIN (SELECT session_id, phrase_id FROM ru) h ON h.session_id = cues.session_id AND h.phrase_id = idx),
    nr AS (SELECT session_id, phrase_id, run, min({{'o': abs(a - 10.0 - start_ms), 'i': i}}) AS m FROM ru JOIN wo USING (session_id, phrase_id) WHERE run > 0 AND i > 1 GROUP BY ALL),
    cu AS (SELECT DISTINCT session_id, phrase_id, m.i AS i FROM nr WHERE m.o <= 250),
    mi AS (SELECT session_id, phrase_id, count(*) > coalesce(any_value(made), 0) AS missed FROM nr LEFT JOIN (SELECT session_id, phrase_id, count(*) AS made FROM cu GROUP BY ALL) USING (session_id, phrase_id) GROUP BY session_id, phrase_id),
    wp AS (SELECT wo.session_id, wo.phrase_id, wo.i, wo.a, wo.b, count(cu.i)::INT AS part FROM wo LEFT JOIN cu ON cu.session_id = wo.session_id AND cu.phrase_id = wo.phrase_id AND cu.i <= wo.i GROUP BY ALL),
    pt AS (SELECT session_id, phrase_id, part, min(a) AS start_ms, max(b) AS end_ms, string_agg('w' || (i - 1), '' ORDER BY i) AS text FROM wp GROUP BY ALL),
    sh AS (SELECT pt.session_id, pt.phrase_id, part, run, owner, cause, least(pt.end_ms, ru.end_ms) - greatest(pt.start_ms, ru.start_ms) AS ms FROM pt JOIN ru USING (session_id, phrase_id)
      WHERE least(pt.end_ms, ru.end_ms) > greatest(pt.start_ms, ru.start_ms)),
    so AS (SELECT session_id, phrase_id, part, owner FROM (SELECT session_id, phrase_id, part, owner, sum(ms) AS ms, min(run) AS run FROM sh GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY session_id, phrase_id, part ORDER BY ms DESC, run) = 1),
    sc AS (SELECT session_id, phrase_id, part, cause FROM (SELECT session_id, phrase_id, part, cause, sum(ms) AS ms, min(run) AS run FROM sh WHERE owner IS NULL GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY session_id, phrase_id, part ORDER BY ms DESC, run) = 1),
    pa AS (SELECT pt.*, so.owner, CASE WHEN so.owner IS NULL THEN CASE coalesce(sc.cause, 'below_margin') WHEN 'floor_gated' THEN '{k.UNCERTAIN_TEXT["floor_gated"]}'
        WHEN 'unstable' THEN '{k.UNCERTAIN_TEXT["unstable"]}' ELSE '{k.UNCERTAIN_TEXT["below_margin"]}' END WHEN coalesce(missed, FALSE) THEN '{k.UNCERTAIN_TEXT["uncut"]}' ELSE '' END AS reason
      FROM pt LEFT JOIN so USING (session_id, phrase_id, part) LEFT JOIN sc USING (session_id, phrase_id, part) LEFT JOIN mi USING (session_id, phrase_id))"""


@query(
    "split_phrase_by_owner",
    "cues frames",
    f"WITH RECURSIVE {PARTS} SELECT session_id, phrase_id, part, start_ms, end_ms, text, owner, reason <> '' AS uncertain, reason FROM pa",
)
def split_phrase_by_owner(spark, sf):
    return _owner_parts(spark, sf)


#: Short parts glued to the one before, part by part; then a short first part to the second.
GLUED = f"""{PARTS}, np AS (SELECT *, row_number() OVER (PARTITION BY session_id, phrase_id ORDER BY part) AS n FROM pa),
    gl(session_id, phrase_id, n, head, a) AS (SELECT session_id, phrase_id, n, n, start_ms FROM np WHERE n = 1
      UNION ALL SELECT np.session_id, np.phrase_id, np.n, CASE WHEN fit THEN head ELSE np.n END, CASE WHEN fit THEN a ELSE np.start_ms END
      FROM gl JOIN np ON np.session_id = gl.session_id AND np.phrase_id = gl.phrase_id AND np.n = gl.n + 1
        JOIN np o ON o.session_id = gl.session_id AND o.phrase_id = gl.phrase_id AND o.n = gl.head,
        LATERAL (SELECT np.end_ms - np.start_ms < 400 AND o.owner IS NOT DISTINCT FROM np.owner AND np.end_ms - a <= 1200 AS fit) x),
    g1 AS (SELECT np.session_id, np.phrase_id, head, min(np.part) AS part, min(np.start_ms) AS start_ms, max_by(np.end_ms, np.n) AS end_ms, string_agg(np.text, '' ORDER BY np.n) AS text, any_value(np.owner) AS owner,
        bool_or(reason <> '') AS uncertain, list_filter(list(reason ORDER BY np.n), lambda r: r <> '') AS rs FROM gl JOIN np USING (session_id, phrase_id, n) GROUP BY np.session_id, np.phrase_id, head),
    g2 AS (SELECT *, row_number() OVER w AS n, lead(owner) OVER w AS o2, lead(end_ms) OVER w AS e2, count(*) OVER (PARTITION BY session_id, phrase_id) AS m FROM g1 WINDOW w AS (PARTITION BY session_id, phrase_id ORDER BY head)),
    fi AS (SELECT session_id, phrase_id FROM g2 WHERE n = 1 AND m > 1 AND end_ms - start_ms < 400 AND owner IS NOT DISTINCT FROM o2 AND e2 - start_ms <= 1200),
    g3 AS (SELECT g2.*, CASE WHEN n = 2 AND fi.session_id IS NOT NULL THEN 1 ELSE n END AS h FROM g2 LEFT JOIN fi USING (session_id, phrase_id))"""


@query(
    "enforce_phrase_len",
    "cues frames",
    f"""WITH RECURSIVE {GLUED} SELECT session_id, phrase_id, min(part) AS part, min(start_ms) AS start_ms, max_by(end_ms, n) AS end_ms, string_agg(text, '' ORDER BY n) AS text, any_value(owner) AS owner,
      bool_or(uncertain) AS uncertain, coalesce(list_aggregate(list_filter(flatten(list(rs ORDER BY n)), lambda r, i: list_position(flatten(list(rs ORDER BY n)), r) = i), 'string_agg', '{k.REASON_SEPARATOR}'), '') AS reason
    FROM g3 GROUP BY session_id, phrase_id, h""",
)
def enforce_phrase_len(spark, sf):
    return fo.enforce_phrase_len(_owner_parts(spark, sf))


@query("annotate_canonical")
def annotate_canonical(spark, sf):
    """Words of every cue aligned to a corrected text of it."""
    words = fx.words(spark, sf).withColumn("block_id", F.col("idx"))
    blocks = fx.cues(spark, sf).select(
        "session_id", F.col("idx").alias("block_id"), F.replace("text", F.lit("th"), F.lit("dh")).alias("text")
    )
    return fo.annotate_canonical(words, blocks)


@query(
    "canonical_text_is_whole",
    "cues",
    r"SELECT session_id, idx AS block_id, regexp_replace(replace(text, 'th', 'dh'), '\s+', '', 'g') AS text FROM cues",
)
def canonical_text_is_whole(spark, sf):
    """The aligned pieces of a cue spell its corrected text."""
    pieces = annotate_canonical(spark, sf)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "ctext"))), lambda x: x["ctext"])
    return pieces.groupBy("session_id", "block_id").agg(F.array_join(listed, "").alias("text"))


@query(
    "migrate_marks",
    "blocks",
    """SELECT session_id, speaker, block_id, '~~' || substr(text, 1, 5) || '~~' || substr(text, 6) AS raw, keep_old AS keep, 1 AS strikes FROM blocks""",
)
def migrate_marks(spark, sf):
    blocks = fx.blocks(spark, sf)
    marked = F.concat(F.lit("~~"), F.substring("text", 1, 5), F.lit("~~"), F.substring("text", 6, 2**31 - 1))
    old = blocks.select("session_id", "speaker", F.col("idx").alias("seq"), F.col("keep_old").alias("keep"), marked.alias("raw"))
    new = blocks.select("session_id", "speaker", F.col("idx").alias("seq"), "block_id", "text")
    return fo.migrate_marks(old, new)


@query("migrate_marks_after_edit")
def migrate_after_edit(spark, sf):
    """Every third new block reads differently."""
    blocks = fx.blocks(spark, sf)
    marked = F.concat(F.lit("~~"), F.substring("text", 1, 5), F.lit("~~"), F.substring("text", 6, 2**31 - 1))
    edited = F.when(F.col("idx") % 3 == 1, F.replace("text", F.lit("que"), F.lit("qui"))).otherwise(F.col("text"))
    old = blocks.select("session_id", "speaker", F.col("idx").alias("seq"), F.col("keep_old").alias("keep"), marked.alias("raw"))
    new = blocks.select("session_id", "speaker", F.col("idx").alias("seq"), "block_id", edited.alias("text"))
    return fo.migrate_marks(old, new)


@query(
    "migrate_marks_unchanged_text",
    "blocks",
    """SELECT session_id, speaker, block_id, keep_old AS keep FROM blocks""",
)
def migrate_unchanged(spark, sf):
    """With unchanged texts every tick arrives where it was."""
    return migrate_marks(spark, sf).select("session_id", "speaker", "block_id", "keep")


@query(
    "migrate_marks_across_speakers",
    "blocks",
    """WITH n AS (SELECT *, CASE WHEN idx % 7 = 3 THEN 'Z' ELSE speaker END AS who FROM blocks),
    lost AS (SELECT DISTINCT o.session_id, o.context, o.at, o.size, o.strike FROM (
        SELECT session_id, speaker, idx, substr(text, 1, 17) AS context, 0 AS at, least(5, length(text)) AS size, true AS strike FROM blocks WHERE text <> ''
        UNION ALL SELECT session_id, speaker, idx, text, 0, length(text), false FROM blocks WHERE NOT keep_old AND text <> '') o WHERE o.idx % 7 = 3),
    places AS (SELECT l.session_id, l.context, l.at, l.size, l.strike, min({'seq': n.idx, 'p': strpos(n.text, l.context)}) AS f FROM lost l JOIN n
        ON n.session_id = l.session_id AND CASE WHEN length(l.context) >= 8 THEN strpos(n.text, l.context) > 0 ELSE n.text = l.context END GROUP BY ALL),
    unticked AS (SELECT session_id, f.seq AS idx, sum(size) AS n FROM places WHERE NOT strike GROUP BY ALL)
    SELECT n.session_id, n.who AS speaker, n.block_id, n.text, n.idx % 7 <> 3 OR p.idx IS NOT NULL AS struck,
        CASE WHEN n.idx % 7 <> 3 THEN n.keep_old ELSE true END AND coalesce(u.n / length(n.text) < 0.6, true) AS keep
    FROM n LEFT JOIN unticked u ON u.session_id = n.session_id AND u.idx = n.idx
    LEFT JOIN (SELECT DISTINCT session_id, f.seq AS idx FROM places WHERE strike) p ON p.session_id = n.session_id AND p.idx = n.idx""",
)
def migrate_across(spark, sf):
    """Every seventh block has another speaker in the new version; its marks go with its text."""
    blocks = fx.blocks(spark, sf)
    marked = F.concat(F.lit("~~"), F.substring("text", 1, 5), F.lit("~~"), F.substring("text", 6, 2**31 - 1))
    old = blocks.select("session_id", "speaker", F.col("idx").alias("seq"), F.col("keep_old").alias("keep"), marked.alias("raw"))
    who = F.when(F.col("idx") % 7 == 3, F.lit("Z")).otherwise(F.col("speaker"))
    new = blocks.select("session_id", who.alias("speaker"), F.col("idx").alias("seq"), "block_id", "text")
    out = fo.migrate_marks(old, new, across="session_id")
    plain = F.replace("raw", F.lit("~~"), F.lit(""))
    return out.select("session_id", "speaker", "block_id", plain.alias("text"), (F.col("strikes") > 0).alias("struck"), "keep")


@query(
    "attach_speakers_by_text",
    "cues",
    "SELECT session_id, idx, speaker FROM cues",
)
def attach_speakers_by_text(spark, sf):
    """Speakers come back from the plan's text, here the same text with other spaces."""
    cues = fx.cues(spark, sf)
    plan = cues.select("session_id", F.col("idx").alias("seq"), "speaker", F.replace("text", F.lit(" "), F.lit("  ")).alias("text"))
    return fo.attach_speakers_by_text(cues.drop("speaker"), plan).select("session_id", "idx", "speaker")


# --- figures ----------------------------------------------------------------------------


def _placement(spark, sf):
    rows = mixed_cues(spark, sf).withColumnRenamed("session_id", "doc_id")
    lines = rows.filter("idx % 3 <> 0").select("doc_id", F.col("idx").alias("line_no"), F.col("text").alias("line"))
    places = fg.context_lines(lines, "doc_id")
    i = F.col("idx")
    figs = rows.filter("idx % 3 = 0").select(
        "doc_id",
        i.alias("fig_id"),
        F.when(i % 6 == 0, i).alias("deck_page"),
        F.format_string("f%03d.png", i).alias("file"),
        tx.terms(F.col("text")).alias("terms"),
    )
    scores = cut_lineage(fg.containment_match(figs.select("doc_id", "fig_id", "terms"), places, "doc_id"))
    return figs.drop("terms"), places.select("doc_id", "line_no"), scores.select("doc_id", "fig_id", "line_no", "score")


@query("converge_placement")
def converge_placement(spark, sf):
    return fo.converge_placement(*_placement(spark, sf))


@query("align_monotonic")
def align_monotonic(spark, sf):
    figs, places, scores = _placement(spark, sf)
    return fo.align_monotonic(figs.filter("deck_page IS NOT NULL"), places, scores)


@query("spread_by_order")
def spread_by_order(spark, sf):
    figs, places, _ = _placement(spark, sf)
    return fo.spread_by_order(figs, places)


@query("dedupe_frames")
def dedupe_frames(spark, sf):
    frames = fx.table(spark, sf, "embeddings").select(
        F.col("label").cast("bigint").alias("session_id"),
        (F.col("vec_id") * 811).alias("t_ms"),
        fg.ring_hash(F.col("embedding")).alias("hash"),
    )
    return fo.dedupe_frames(frames, max_bits=20)


@query("dehyphenate")
def dehyphenate(spark, sf):
    """Whole document texts with their spaces turned into line breaks now and then."""
    broken = F.regexp_replace("text", "(que|the) ", "$1\n")
    docs = fx.table(spark, sf, "documents").select("doc_id", broken.alias("text"))
    return fo.dehyphenate(docs)


def _boxes(spark, sf):
    v = F.col("vec_id")
    e = fx.table(spark, sf, "embeddings")
    x0 = (v % 6) * 20.0 + (v % 3) * 0.4
    y0 = F.floor(v / 6) * 12.0
    return e.select(
        F.col("label").alias("doc_id"),
        (v % 4).alias("page"),
        v.alias("pos"),
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + 10.0).alias("x1"),
        (y0 + 11.0).alias("y1"),
        F.substring(F.lit(fx.IDEOGRAPHS), (v % 26 + 1).cast("int"), F.lit(1)).alias("text"),
    )


@query("order_vertical_page")
def order_vertical_page(spark, sf):
    return fo.order_vertical_page(_boxes(spark, sf))


@query("collapse_dup_slots")
def collapse_dup_slots(spark, sf):
    boxes = _boxes(spark, sf).withColumn("pitch", F.lit(150.0))
    return fo.collapse_dup_slots(boxes, ["doc_id", "page"])


@query("table_from_boxes")
def table_from_boxes(spark, sf):
    v = F.col("vec_id")
    boxes = fx.table(spark, sf, "embeddings").select(
        F.col("label").alias("frame_id"),
        v.alias("pos"),
        (v % 3 * 0.3).alias("x"),
        (F.floor(v / 3) % 30 * 0.03).alias("y"),
        v.cast("string").alias("text"),
    )
    return fo.table_from_boxes(boxes)


@query(
    "enforce_monotonic",
    "turns",
    """WITH RECURSIVE r AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn_idx) AS n, turn_idx AS seq, start_ms AS a, start_ms + 300 + turn_idx % 2500 AS b FROM turns WHERE turn_idx % 10 <> 9),
    f(session_id, n, seq, a, b, kept, pa, pb) AS (SELECT session_id, n, seq, a, b, b - a >= 120, CASE WHEN b - a >= 120 THEN a END, CASE WHEN b - a >= 120 THEN b END FROM r WHERE n = 1
      UNION ALL SELECT r.session_id, r.n, r.seq, x.a2, r.b, r.b - x.a2 >= 120, CASE WHEN r.b - x.a2 >= 120 THEN x.a2 ELSE f.pa END, CASE WHEN r.b - x.a2 >= 120 THEN r.b ELSE f.pb END
      FROM f JOIN r ON r.session_id = f.session_id AND r.n = f.n + 1, LATERAL (SELECT CASE WHEN f.pa < r.a AND r.a < f.pb THEN f.pb ELSE r.a END AS a2) x)
    SELECT session_id, seq, a AS start_ms, b AS end_ms FROM f WHERE kept
    UNION ALL SELECT session_id, turn_idx, start_ms, start_ms + 300 + turn_idx % 2500 FROM turns WHERE turn_idx % 10 = 9""",
)
def enforce_monotonic(spark, sf):
    n = F.col("turn_idx")
    segments = fx.turns(spark, sf).select(
        "session_id",
        n.alias("seq"),
        F.lit("speech").alias("kind"),
        (n % 10 == 9).alias("clip"),
        "start_ms",
        (F.col("start_ms") + n % 2500 + 300).alias("end_ms"),
    )
    return mo.enforce_monotonic(segments).select("session_id", "seq", "start_ms", "end_ms")
