"""Chat logs folded into final messages and rendered for training, with SQL functions only.

A log is a table of events, one row each: the conversation, a sequence
number, the message (turn) the event belongs to, its kind and a text:

``delta``       adds its text to the end of the message
``edit``        replaces all that the message held
``regenerate``  empties the message and deletes all later ones
``delete``      deletes the message

Events are partitioned by conversation and message, sorted by sequence and
folded: what counts are the deltas since the last event that emptied the
message. Partial deltas of a message meet in one row, as the message itself
does, and messages of a conversation meet only once they are folded.

Null texts count as empty, null roles as "", unknown kinds as ``delta``; a
null conversation is one more conversation. Events with equal sequence numbers
are taken in the order of kind and text; repeated rows are repeated events. An
empty log gives no conversations.

The template marks a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Control
strings inside texts get one backslash behind their first sign (one more if
there are some), which ``unescape`` takes away again, so no text can end its
turn or be read as a turn of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>"
# Control strings of common chat templates, without their first sign.
_REST = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>"
_ESCAPE = rf"([<\[])(\\*)({_REST})"
_UNESCAPE = rf"([<\[])\\(\\*)({_REST})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, r"$1$2$3")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the messages that are left at the end of the log."""
    kind = F.coalesce("kind", F.lit("delta"))
    rows = events.select(
        "conv_id", "turn", "seq", kind.alias("kind"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    # the last regeneration below each message; one small row a conversation and turn
    again = rows.filter("kind = 'regenerate'").groupBy("conv_id", "turn").agg(F.max("seq").alias("at"))
    again = again.groupBy(F.col("conv_id").alias("again_in")).agg(F.collect_list(F.struct("turn", "at")).alias("again"))
    event = F.struct("seq", "kind", "text", "role")
    messages = rows.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(event)).alias("log"))
    messages = messages.join(again, F.col("conv_id").eqNullSafe(F.col("again_in")), "left")
    gone = F.array_max(F.transform(F.filter("again", lambda r: r["turn"] < F.col("turn")), lambda r: r["at"]))
    left = F.filter("log", lambda e: F.coalesce(e["seq"] > F.col("gone"), F.lit(True)))
    emptied = F.array_max(F.transform("log", lambda e, i: F.when(e["kind"].isin("edit", "regenerate", "delete"), i)))
    since = F.when(F.col("emptied").isNull(), F.col("log")).otherwise(
        F.slice("log", F.col("emptied") + 1, F.size("log") - F.col("emptied"))
    )
    last = F.element_at("log", -1)
    return (
        messages.withColumn("gone", gone)
        .withColumn("log", left)
        .filter(F.size("log") > 0)
        .withColumn("emptied", emptied)
        .withColumn("log", since)
        .filter((F.element_at("log", 1)["kind"] != "delete") | (F.size("log") > 1))
        .select(
            "conv_id", "turn", last["role"].alias("role"),
            F.array_join(
                F.transform("log", lambda e: F.when(e["kind"] == "delete", "").otherwise(e["text"])), ""
            ).alias("text"),
        )
    )


def message_events(rows: DataFrame) -> DataFrame:
    """The log of finished messages: one ``delta`` each, in the order of turn, role and text."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    packed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    placed = packed.select("conv_id", F.posexplode("rows").alias("seq", "row"))
    return placed.select(
        "conv_id", "seq", F.col("seq").alias("turn"), F.lit("delta").alias("kind"), "row.role", "row.text"
    )


def role_line(role: Column) -> Column:
    """A role as one line: backslash and line end are written as two signs."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def role_of(line: Column) -> Column:
    # between two backslash pairs a backslash only stands before an n
    parts = F.split(line, r"\\\\", -1)
    return unescape(F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): loss_spans are (start from 0, length) of the texts to learn from.

    Messages of a conversation come by turn, then role and text.
    """
    turns = messages.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    head = F.concat(F.lit(START), role_line(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    row = F.struct("turn", "role", "text", head.alias("head"), body.alias("body"))
    packed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    tail = F.lit(END + "\n")
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], tail)), "")
    # running offsets: each element of ``spans`` carries where the next turn begins
    width = lambda t: F.char_length(t["head"]) + F.char_length(t["body"]) + len(END) + 1
    ends = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + width(t)).alias("at"),
            F.when(
                t["role"] == "assistant",
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.char_length(t["head"])).alias("start"), F.char_length(t["body"]).alias("length")
                        )
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )
    return packed.select("conv_id", formatted.alias("formatted"), ends["spans"].alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The (role, text) turns of a rendered conversation."""
    chunks = F.split(formatted, r"<\|im_end\|>\n")
    chunks = F.slice(chunks, 1, F.size(chunks) - 1)  # nothing follows the last end mark
    at = lambda c: F.locate("\n", c)
    return F.transform(
        chunks,
        lambda c: F.struct(
            role_of(F.substring(c, F.lit(len(START) + 1), at(c) - len(START) - 1)).alias("role"),
            unescape(F.substring(c, at(c) + 1, F.char_length(c))).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), ""
    )


def digests(rendered: DataFrame) -> DataFrame:
    """Counts and digests of the conversations, read back from their rendering."""
    read = rendered.select(
        "conv_id", "formatted", read_back(F.col("formatted")).alias("turns"),
        loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
