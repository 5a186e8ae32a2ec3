"""Chat formatting: a finite-state machine over roles and segments with loss flags from a template.

The machine's moves and the template are tables.  Turns are formatted in runs of consecutive turn
numbers, each of which also carries the machine from every state; the runs of a conversation are
then put together in order, so a long conversation is formatted by many tasks.  Only DataFrame functions are used.

Texts and roles are escaped: a backslash, and either bracket, become a backslash and a letter.  No
bracket is left outside the template's own marks, so the output is read back exactly.

Null texts and null roles are empty.  Unknown roles are formatted without loss and fail the
machine.  Turns are ordered by number (null last), then role and text.  A null conversation id is a conversation.
An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template: what stands before and after each text, and the roles whose texts carry loss.
TEMPLATE = {"open": "<turn ", "name_end": ">", "close": "</turn>\n", "loss": ("assistant",)}
#: The machine: state and role to the next state.  All else fails; ``answered`` is a complete conversation.
STATES = ("start", "instructed", "asked", "answered", "failed")
ROLES = ("system", "user", "assistant", "tool")
MOVES = {
    ("start", "system"): "instructed",
    ("start", "user"): "asked",
    ("instructed", "user"): "asked",
    ("asked", "assistant"): "answered",
    ("answered", "user"): "asked",
    ("answered", "tool"): "asked",
}
COMPLETE = ("answered",)
#: Turn numbers in a run.
RUN_TURNS = 64
#: The escapes.  The backslash is the first to be written and the last to be read.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escaped(text: Column) -> Column:
    for raw, written in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def unescaped(text: Column) -> Column:
    for raw, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(raw))
    return text


def _moves() -> Column:
    """For each role (and any other, last) the next state of each state."""
    fail = STATES.index("failed")
    rows = [[STATES.index(MOVES.get((s, r), "failed")) for s in STATES] for r in ROLES] + [[fail] * len(STATES)]
    return F.array(*[F.array(*[F.lit(x) for x in row]) for row in rows])


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, segments (text, loss), formatted, n_turns, state, valid."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    number = F.array_position(F.array(*[F.lit(r) for r in ROLES]), role)
    rows = turns.select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / RUN_TURNS), F.lit((1 << 62))).cast("bigint").alias("run"),
        F.struct(
            F.col("turn").isNull().alias("unnumbered"),
            F.col("turn").alias("turn"),
            role.alias("role"),
            text.alias("text"),
            F.when(number > 0, number - 1).otherwise(len(ROLES)).cast("int").alias("kind"),
        ).alias("t"),
    )
    runs = rows.groupBy("conv_id", "run").agg(F.array_sort(F.collect_list("t")).alias("ts"))

    def segments(t: Column) -> Column:
        head = F.concat(F.lit(TEMPLATE["open"]), escaped(t["role"]), F.lit(TEMPLATE["name_end"]))
        loss = t["role"].isin(*TEMPLATE["loss"])
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(t["text"]).alias("text"), loss.alias("loss")),
            F.struct(F.lit(TEMPLATE["close"]).alias("text"), F.lit(False).alias("loss")),
        )

    moves = _moves()
    carried = F.aggregate(
        "ts",
        F.array(*[F.lit(i) for i in range(len(STATES))]),
        lambda states, t: F.transform(states, lambda s: F.get(F.get(moves, t["kind"]), s)),
    )
    formatted = runs.select(
        "conv_id",
        F.struct(
            "run",
            F.flatten(F.transform("ts", segments)).alias("segments"),
            carried.alias("carried"),
            F.size("ts").cast("bigint").alias("n"),
        ).alias("r"),
    )
    whole = formatted.groupBy("conv_id").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    end = F.aggregate("rs", F.lit(STATES.index("start")), lambda s, r: F.get(r["carried"], s))
    return (
        whole.select(
            "conv_id",
            F.flatten(F.transform("rs", lambda r: r["segments"])).alias("segments"),
            F.aggregate("rs", F.lit(0).cast("bigint"), lambda n, r: n + r["n"]).alias("n_turns"),
            F.get(F.array(*[F.lit(s) for s in STATES]), end).alias("state"),
        )
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
        .withColumn("valid", F.col("state").isin(*COMPLETE))
    )


def turns_of(formatted: Column) -> Column:
    """The turns (role, text) as read from the formatted text alone."""
    pieces = F.filter(F.split(formatted, TEMPLATE["close"]), lambda p: p != "")
    begin, mark = len(TEMPLATE["open"]), TEMPLATE["name_end"]

    def turn(piece: Column) -> Column:
        end = F.instr(piece, mark)
        return F.struct(
            unescaped(F.substr(piece, F.lit(begin + 1), end - (begin + 1))).alias("role"),
            unescaped(F.substr(piece, end + 1)).alias("text"),
        )

    return F.transform(pieces, turn)


def chat_digest(turns: DataFrame) -> DataFrame:
    """The digest rows of the formatting query, read back from the output."""
    spark = turns.sparkSession
    said = "\\### Assistant: </turn> ok"
    turn = F.col("id")
    trial = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), turn.alias("turn"), F.when(turn == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    output = format_conversations(turns.select("conv_id", "turn", "role", "text").unionByName(trial))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    kept = output.select("conv_id", "formatted", "state", "valid", loss.alias("loss_text"))
    back = kept.withColumn("turns", turns_of(F.col("formatted")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "state",
        "valid",
    )


#: The machine is a regular language over roles, so SQL can say where it ends.
CHAT_SQL = r"""
WITH t AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM t
), e AS (
    SELECT *, length(regexp_replace(role, '([\\<>])', 'xx', 'g')) + length(regexp_replace(text, '([\\<>])', 'xx', 'g')) + 15 AS n FROM c
), g AS (
    SELECT conv_id, count(*) AS n_turns,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS lines,
           coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, text) FILTER (WHERE role = 'assistant'), '') AS loss,
           CAST(sum(n) AS BIGINT) AS formatted_chars,
           string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' WHEN 'tool' THEN 't' ELSE 'x' END, ''
                      ORDER BY turn NULLS LAST, role, text) AS roles
    FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars,
       CASE WHEN regexp_full_match(roles, 's') THEN 'instructed'
            WHEN regexp_full_match(roles, 's?u(a[ut])*') THEN 'asked'
            WHEN regexp_full_match(roles, 's?ua([ut]a)*') THEN 'answered'
            ELSE 'failed' END AS state,
       regexp_full_match(roles, 's?ua([ut]a)*') AS valid
FROM g
"""
