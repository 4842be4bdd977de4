"""Chat logs folded into final messages and rendered, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm.common import read, stored

#: The template: OPEN, then for each turn HEAD role TAIL text END.
OPEN, HEAD, TAIL, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = (OPEN, END, HEAD, TAIL)
#: Kinds of event of a log.
MESSAGE, DELTA, EDIT, REGENERATE = "message", "delta", "edit", "regenerate"
#: Values of seq or turn that are sorted together.
RANGE = 1024
EXTRA_CONV = -7
EXTRA_TEXT = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    """text without any control string: a backslash goes before each backslash and after the first character of each control string."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescape(text: Column) -> Column:
    """The inverse of escape: of each backslash and the character after it, only the latter stays."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def as_events(conversations: DataFrame) -> DataFrame:
    """Rows of finished turns as an event log: one message event, and one message, for each row.

    The log is stored, so that the numbers that tell equal rows apart are given once.
    """
    msg = F.struct(F.col("turn"), F.monotonically_increasing_id().alias("copy"))
    return stored(conversations.select("conv_id", F.col("turn").alias("seq"), F.lit(MESSAGE).alias("kind"), msg.alias("msg"), "turn", "role", "text"))


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) from a log of events.

    events: conv_id, seq, kind, msg, turn, role, text. `msg` names the message
    that an event belongs to, of any type. In the order of seq, a message or an
    edit sets the whole text, a regenerate starts it anew with its own text, and
    a delta appends; the text is what stands from the last event that is not a
    delta. turn and role are the smallest turn and the role of the latest event
    that has one, null if there is none. A null text counts as empty; events of
    equal seq are taken in the order of kind and text; a null seq comes first.
    Events that hold the same in every column all count. Other columns are ignored.

    The last reset of each message is a partial aggregate; what follows it is
    put together in ranges of seq, and these ranges joined, so that a message of
    very many deltas is sorted in parts.
    """
    at = F.coalesce("seq", F.lit(-(1 << 62))).cast("long")
    e = events.select("conv_id", "msg", at.alias("seq"), "kind", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    e = e.withColumn("seq_range", F.floor(F.col("seq") / RANGE))
    reset = F.max(F.when(F.col("kind") != DELTA, F.col("seq")))
    heads = e.groupBy("conv_id", "msg").agg(reset.alias("from_seq"), F.min("turn").alias("turn"), F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("named"))
    same = F.col("e.conv_id").eqNullSafe(F.col("h.conv_id")) & F.col("e.msg").eqNullSafe(F.col("h.msg"))
    live = e.alias("e").join(heads.alias("h"), same).where(F.col("from_seq").isNull() | (F.col("e.seq") >= F.col("from_seq")))
    live = live.select("e.conv_id", "e.msg", "e.seq_range", "e.seq", "e.kind", "e.text", "h.turn", F.col("h.named.role").alias("role"))
    # of the events at the reset's own seq the last one that is not a delta counts
    sorted_ = F.sort_array(F.collect_list(F.struct("seq", "kind", "text")))
    part = live.groupBy("conv_id", "msg", "seq_range", "turn", "role").agg(sorted_.alias("es"))
    resets = F.array_max(F.transform("es", lambda x, i: F.when(x["kind"] != DELTA, i).otherwise(-1)))
    part = part.withColumn("cut", F.greatest(resets, F.lit(0)))
    text = F.array_join(F.transform(F.slice("es", F.col("cut") + 1, F.size("es")), lambda x: x["text"]), "")
    part = part.select("conv_id", "msg", "turn", "role", "seq_range", text.alias("text"))
    whole = part.groupBy("conv_id", "msg", "turn", "role").agg(F.sort_array(F.collect_list(F.struct("seq_range", "text"))).alias("ps"))
    return whole.select("conv_id", "turn", "role", F.array_join(F.transform("ps", lambda x: x["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted and mask of every conversation of messages (conv_id, turn, role, text).

    Turns stand in the order of turn, role and text, nulls first; a null role or
    text counts as empty. mask has (before, loss, after) for each turn: how many
    code points of the formatted turn come before, under and after the loss.
    Texts of assistants are under the loss, nothing else is. Turns are formatted
    row by row and sorted in ranges of turns, so that only finished strings meet
    in one place for a long conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    m = messages.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    head = F.concat(F.lit(HEAD), escape(F.col("role")), F.lit(TAIL))
    said = escape(F.col("text"))
    m = m.select("conv_id", "turn", "role", "text", head.alias("head"), said.alias("said"))
    is_loss = F.col("role") == "assistant"
    size = F.length("said")
    runs = F.struct(
        (F.length("head") + F.when(is_loss, 0).otherwise(size)).alias("before"),
        F.when(is_loss, size).otherwise(0).alias("loss"),
        F.lit(len(END)).alias("after"),
    )
    turn = F.struct("turn", "role", "text", F.concat("head", "said", F.lit(END)).alias("piece"), runs.alias("runs"))
    part = m.groupBy("conv_id", F.floor(F.col("turn") / RANGE).alias("turn_range")).agg(F.sort_array(F.collect_list(turn)).alias("ts"))
    part = part.select("conv_id", "turn_range", F.array_join(F.transform("ts", lambda t: t["piece"]), "").alias("piece"), F.transform("ts", lambda t: t["runs"]).alias("runs"))
    whole = part.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn_range", "piece", "runs"))).alias("ps"))
    pieces = F.array_join(F.transform("ps", lambda p: p["piece"]), "")
    return whole.select("conv_id", F.concat(F.lit(OPEN), pieces).alias("formatted"), F.flatten(F.transform("ps", lambda p: p["runs"])).alias("mask"))


def _pieces(formatted: Column) -> Column:
    """The formatted turns, without END."""
    body = F.split(formatted.substr(F.lit(len(OPEN) + 1), F.length(formatted)), END)
    return F.slice(body, 1, F.size(body) - 1)


def turns_of(formatted: Column) -> Column:
    """Roles and texts, read back from a formatted conversation."""

    def read_turn(piece: Column) -> Column:
        parts = F.split(piece, r"\[/INST\]", 2)
        return F.struct(unescape(parts[0].substr(F.lit(len(HEAD) + 1), F.length(piece))).alias("role"), unescape(parts[1]).alias("text"))

    return F.transform(_pieces(formatted), read_turn)


def loss_of(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, in order."""
    return unescape(F.array_join(F.zip_with(_pieces(formatted), mask, lambda p, m: p.substr(m["before"] + 1, m["loss"])), ""))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(EXTRA_CONV).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TEXT).alias("text"),
    )
    done = render(fold(as_events(rows.unionByName(extra))))
    turns = turns_of(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = loss_of(F.col("formatted"), F.col("mask"))
    return done.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escape(x: str) -> str:
    x = f"replace({x}, '\\', '\\\\')"
    for c in CONTROL:
        x = f"replace({x}, '{c}', '{c[0]}\\{c[1:]}')"
    return x


OP6_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7::BIGINT, 0::BIGINT, 'user', '{EXTRA_TEXT}'), (-7::BIGINT, 1::BIGINT, 'assistant', '{EXTRA_TEXT}')
), whole AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length({_sql_escape("role")}) + length({_sql_escape("text")}) + {len(HEAD + TAIL + END)}) AS inner_chars
  FROM rows GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  (inner_chars + {len(OPEN)})::BIGINT AS formatted_chars
FROM whole
"""
