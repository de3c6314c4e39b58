"""Chat formatting with DataFrame functions only.

Conversations are logs of events ``(conversation, seq, message, kind, role,
text)``.  Kinds: ``message`` starts a message, ``delta`` appends to it, ``edit``
replaces its text, ``regenerate`` empties it so that later deltas rebuild it,
``delete`` removes it.  Events are first folded per (conversation, message), so
that one busy conversation is spread over many tasks, then messages per
conversation, and the result is rendered with a template that marks turns.

In the template, a message is ``<|start|>role<|content|>text<|end|>``.  Within
role and text a backslash becomes two and ``<|`` becomes ``<\\|``, so a control
string never occurs inside a text and the escape is undone exactly.

Defined results: null role and text are empty; a null conversation id is a
conversation of its own; a null seq or message sorts first; events alike in
every field count each (as two messages if they are messages); a conversation
whose messages are all deleted gives no row; an empty log gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, CONTENT, END = "<|start|>", "<|content|>", "<|end|>"
#: Kinds after which what a message held before no longer counts.
RESETS = ("message", "edit", "regenerate", "delete")
KINDS = (*RESETS, "delta")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, ord, role, text): the final messages.

    ``events`` has conv_id, seq, message, kind, role, text.  The last reset of a
    message and the deltas after it make its text; its place is that of its first
    event; its role is the first one given from the last ``message`` on.
    """
    e = F.struct("seq", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("k"), "role", "text")
    log = F.sort_array(F.collect_list(e))
    one = events.groupBy("conv_id", "message").agg(log.alias("log"))
    last = F.array_max(F.transform("log", lambda x, i: F.when(x["k"] <= len(RESETS), i).otherwise(-1)))
    rest = F.filter("log", lambda x, i: i >= F.col("last"))
    one = one.withColumn("last", last).withColumn("rest", rest)
    one = one.where(F.col("rest")[0]["k"] != KINDS.index("delete") + 1)
    roles = F.filter("log", lambda x: x["role"].isNotNull())
    return one.select(
        "conv_id",
        F.struct(F.col("log")[0]["seq"].alias("seq"), F.col("message").alias("message")).alias("ord"),
        F.coalesce(F.get(roles, F.lit(0))["role"], F.lit("")).alias("role"),
        F.array_join(F.transform("rest", lambda x: F.coalesce(x["text"], F.lit(""))), "").alias("text"),
    )


def events_of_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn as a log of ``message`` events.  Rows of one turn are different messages, in the order of role and text."""
    key = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    logs = turns.select(F.col(conv).cast("long").alias("conv_id"), key.alias("t")).groupBy("conv_id", "t").agg(F.count("*").alias("n"))
    logs = logs.select("conv_id", "t", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    return logs.select("conv_id", F.col("t.turn").cast("long").alias("seq"), F.struct(F.col("t.turn"), F.col("t.role"), F.sha2("t.text", 256).alias("of"), "copy").alias("message"), F.lit("message").alias("kind"), F.col("t.role").alias("role"), F.col("t.text").alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): messages of each conversation in order; spans (code point from 1, length) of what is learned."""
    m = F.struct("ord", "role", "text")
    conv = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(m)).alias("m"))
    parts = F.transform("m", lambda x: F.struct(F.concat(F.lit(START), escaped(x["role"]), F.lit(CONTENT)).alias("head"), escaped(x["text"]).alias("body"), (x["role"] == loss_role).alias("loss")))
    conv = conv.select("conv_id", parts.alias("p"))
    begin = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,len:int>>").alias("spans"))
    step = lambda a, x: F.struct(
        (a["at"] + F.length(x["head"]) + F.length(x["body"]) + len(END)).alias("at"),
        F.when(x["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("len"))))).otherwise(a["spans"]).alias("spans"),
    )
    return conv.select("conv_id", F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"), F.aggregate("p", begin, step, lambda a: a["spans"]).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role,text>> of a rendered conversation."""
    pieces = F.slice(F.split(formatted, r"<\|end\|>"), 1, F.size(F.split(formatted, r"<\|end\|>")) - 1)
    half = lambda x: F.split(F.substring(x, len(START) + 1, 1 << 30), r"<\|content\|>")
    return F.transform(pieces, lambda x: F.struct(unescaped(half(x)[0]).alias("role"), unescaped(half(x)[1]).alias("text")))


def learned(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, s["start"], s["len"]))), "")


def format_turns(turns: DataFrame) -> DataFrame:
    """Turn rows to rendered conversations: log, fold, render."""
    return render(fold_events(events_of_turns(turns)))


def digests(rendered: DataFrame) -> DataFrame:
    """What the rendered conversations hold, read back from them."""
    back = rendered.select("conv_id", "formatted", read_back(F.col("formatted")).alias("t"), learned(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    turns = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
