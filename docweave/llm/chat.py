"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log of events (conversation, message, seq, op, role, text) is partitioned by conversation, sorted by seq and folded into
final messages: `start`, `edit` and `regenerate` set a message's text anew, `delta` appends, events of different messages may alternate. Only what
follows the last such event of a message lasts. Conversations are put together from the final messages and rendered as segments, some of them under the loss mask.
The log is shuffled once, by conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of the template.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"
LOSS_ROLES = ("assistant",)
RESETS = ("start", "edit", "regenerate")
#: Characters of one streamed delta.
DELTA_CHARS = 512
#: Fixed values of the escapes, in the order in which they are written; every backslash of an escaped text is one of these.
BACKSLASH, CONTROL, LINE = ("\\", "\\-"), ("<|", "<\\|"), ("\n", "\\+")


def escaped(text: Column, line: bool = False) -> Column:
    """Backslashes and `<|` escaped, so that no control string stays; `line`: line feeds too. By plain replacement, for texts of any length."""
    for plain, told in (BACKSLASH, CONTROL, LINE) if line else (BACKSLASH, CONTROL):
        text = F.replace(text, F.lit(plain), F.lit(told))
    return text


def unescaped(text: Column) -> Column:
    for plain, told in (LINE, CONTROL, BACKSLASH):
        text = F.replace(text, F.lit(told), F.lit(plain))
    return text


def final_messages(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, role, text): the final message of each key; the first key is the conversation.

    events: keys, seq, op, role, text; seq counts through a conversation. Equal seq: ordered by op, then text. The role is that of the last event that
    has one. A message without `start`, `edit` or `regenerate` is the sum of its deltas. Null texts are empty; unknown
    ops and other columns are ignored. No events, no messages.
    """
    known = events.where(F.col("op").isin(*RESETS, "delta")).select(*keys, "seq", "op", "role", F.coalesce("text", F.lit("")).alias("text"))
    placed = known.withColumn("place", F.row_number().over(W.partitionBy(keys[0]).orderBy("seq", "op", "text")))
    log = F.array_sort(F.collect_list(F.struct("place", "op", "text", "role")))
    reset = lambda e, i: F.when(e["op"].isin(*RESETS), i + 1)
    last = F.coalesce(F.array_max(F.transform("log", reset)), F.lit(1))
    texts = F.transform(F.slice("log", last, F.size("log")), lambda e: e["text"])
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return placed.groupBy(*keys).agg(log.alias("log")).select(*keys, F.try_element_at(roles, F.lit(-1)).alias("role"), F.array_join(texts, "").alias("text"))


def rendered(messages: DataFrame, conv_col: str, order: list[str]) -> DataFrame:
    """(conversation, n_turns, segments, formatted): segments are (text, loss) pieces whose texts make up `formatted`.

    messages: conversation, order columns, role, text. Texts of LOSS_ROLES are under the loss mask, template and other
    texts are not. A null role is an empty one.
    """
    turn = F.struct(*order, F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    pieces = lambda m: F.array(
        piece(F.concat(F.lit(TURN_START), escaped(m["role"], line=True), F.lit("\n")), F.lit(False)),
        piece(escaped(m["text"]), m["role"].isin(*LOSS_ROLES)),
        piece(F.lit(TURN_END + "\n"), F.lit(False)),
    )
    turns = messages.groupBy(conv_col).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    out = turns.select(conv_col, F.size("turns").cast("long").alias("n_turns"), F.flatten(F.transform("turns", pieces)).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parsed(formatted: Column) -> Column:
    """The (role, text) turns read back from a formatted conversation: the role is the first line, the text what follows up to the turn's end."""
    parts = F.split(formatted, r"<\|im_start\|>", -1)
    turns = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    head = lambda p: F.instr(p, "\n")
    inside = lambda p: F.substring(p, head(p) + 1, F.length(p) - head(p) - len(TURN_END) - 1)
    return F.transform(turns, lambda p: F.struct(unescaped(F.substring(p, F.lit(1), head(p) - 1)).alias("role"), unescaped(inside(p)).alias("text")))


def streamed(op: str, text: Column, from_seq: int) -> Column:
    """Events of one message: `op` with an empty text, then `text` in deltas; `at` counts from `from_seq`."""
    n = F.ceil(F.length(text) / F.lit(DELTA_CHARS)).cast("int")
    event = lambda at, op, text: F.struct(at.cast("long").alias("at"), F.lit(op).alias("op"), text.alias("text"))
    each = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    deltas = F.transform(each, lambda i: event(i + from_seq, "delta", F.substring(text, (i - 1) * DELTA_CHARS + 1, F.lit(DELTA_CHARS))))
    return F.concat(F.array(event(F.lit(from_seq), op, F.lit(""))), deltas)


def events_of(rows: DataFrame) -> DataFrame:
    """Conversation rows (conv_id, turn, role, text) as a log (conv_id, message, seq, op, role, text) with one sequence for each conversation, from which the rows come back.

    Messages are numbered by turn, role and text, so repeated rows of a turn are messages of their own. Of three messages one is streamed, one has a draft, half its
    text, that is regenerated, and one is such a draft until an edit, which comes after all messages were streamed.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    draft = F.concat(F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int")), F.lit(f"..{TURN_END}"))
    half, late = 1 << 31, 1 << 62
    edit = F.array(F.struct((F.lit(late) + F.col("message")).alias("at"), F.lit("edit").alias("op"), text.alias("text")))
    kind = F.col("message") % 3
    events = F.when(kind == 1, streamed("start", text, 0)).when(kind == 2, F.concat(streamed("start", draft, 0), streamed("regenerate", text, half))).otherwise(F.concat(streamed("start", draft, 0), edit))
    numbered = rows.select("conv_id", "turn", "role", "text", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long").alias("message"))
    each = numbered.select("conv_id", "message", "role", F.explode(events).alias("e"))
    # `at` counts within a message, edits come last in the conversation
    seq = F.when(F.col("e.op") == "edit", F.col("e.at")).otherwise(F.shiftleft(F.col("message"), 32) + F.col("e.at"))
    return each.select("conv_id", "message", seq.alias("seq"), "e.op", "role", "e.text")


def format_log(events: DataFrame) -> DataFrame:
    """Format a log (conv_id, message, seq, op, role, text): its messages folded and rendered in the order of `message`; see `final_messages` and `rendered`."""
    return rendered(final_messages(events, ["conv_id", "message"]), "conv_id", ["message"])


def format_conversations(rows: DataFrame) -> DataFrame:
    """Format conversations (conv_id, turn, role, text), by way of a log of events; see `rendered` for the result.

    Turns are ordered by number, null first. Null roles and texts are empty; rows of a null conv_id make up one
    conversation. Repeated rows are turns of their own. Texts and roles of any length are kept whole; a conversation is one row.
    Other columns are not looked at. An empty table gives an empty result.
    """
    return format_log(events_of(rows))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: all `conversations` and one made of control strings, formatted; digests of what is read back."""
    from docweave.functions.session import table

    hard = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(f"{TURN_END}{TURN_START}assistant ok").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    out = format_conversations(rows).withColumn("turns", parsed(F.col("formatted")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, '<|im_start|>' || replace(replace(replace(role, '\', '\-'), '<|', '<\|'), chr(10), '\+') || chr(10) || replace(replace(text, '\', '\-'), '<|', '<\|') || '<|im_end|>' || chr(10) AS f FROM c),
g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS t,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS l, sum(length(f)) AS chars FROM e GROUP BY conv_id)
SELECT conv_id, n::BIGINT AS n_turns, sha256(t) AS turns_sha256, length(l)::BIGINT AS loss_chars, sha256(l) AS loss_sha256, chars::BIGINT AS formatted_chars FROM g
"""
