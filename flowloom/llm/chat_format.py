"""Chat formatting by a grammar round trip (native: DataFrame functions only).

A conversation is rendered with a template, the rendered string is read back by a deterministic parser,
and the recovered turns are compared with the source. Where they differ, the texts are escaped one level
further and the trip is made again, until both are identical:

* level 0: texts as they are;
* level 1: the control strings of the template and the escape mark are escaped;
* level 2: every bracket of the template's alphabet is escaped, so that no text can hold a control string.

Template (the escape mark is ``~``; ``~0 ~1 ~2 ~3`` stand for ``~ < [ ]``):

* user: ``<s>[INST] text [/INST]``
* assistant: ``<s>text</s>``
* any other role: ``<s>[ROLE role] text [/ROLE]``

Rows are ordered by turn, then role, then text (nulls first), so ties and repeated rows have a fixed order and stay.
A null text or role counts as empty. Rows with a null conv_id form one conversation of their own. Further columns
of the input are ignored. One conversation is held by one task: its digest is a fold over all of its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USER_OPEN, USER_CLOSE = "<s>[INST] ", " [/INST]"
ROLE_OPEN, ROLE_MIDDLE, ROLE_CLOSE = "<s>[ROLE ", "] ", " [/ROLE]"
BOT_OPEN, BOT_CLOSE = "<s>", "</s>"
GRAMMAR = r"(?s)<s>(?:\[INST\] .*? \[/INST\]|\[ROLE [^\]]*\] .*? \[/ROLE\]|.*?</s>)"
TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column, level: int) -> Column:
    """Escaped text. Its inverse, unescape(), is the same for every level."""
    if level == 0:
        return text
    text = F.replace(text, F.lit("~"), F.lit("~0"))
    if level == 1:
        text = F.regexp_replace(text, r"<(?=/?s>)", "~1")
        return F.regexp_replace(text, r"\[(?=/?INST\]|ROLE |/ROLE\])", "~2")
    for mark, plain in (("~1", "<"), ("~2", "["), ("~3", "]")):
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescape(text: Column) -> Column:
    for mark, plain in (("~1", "<"), ("~2", "["), ("~3", "]"), ("~0", "~")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def render(turns: Column, level: int) -> Column:
    def one(t: Column) -> Column:
        text = escape(t["text"], level)
        role = escape(t["role"], 2 if level else 0)
        return (
            F.when(t["role"] == "user", F.concat(F.lit(USER_OPEN), text, F.lit(USER_CLOSE)))
            .when(t["role"] == "assistant", F.concat(F.lit(BOT_OPEN), text, F.lit(BOT_CLOSE)))
            .otherwise(F.concat(F.lit(ROLE_OPEN), role, F.lit(ROLE_MIDDLE), text, F.lit(ROLE_CLOSE)))
        )

    return F.array_join(F.transform(turns, one), "")


def pieces(formatted: Column) -> Column:
    """The turns of the formatted string as they stand there, escaped and with their marks."""
    return F.regexp_extract_all(formatted, F.lit(GRAMMAR), F.lit(0))


def _is_user(m: Column) -> Column:
    return m.startswith(USER_OPEN) & m.endswith(USER_CLOSE)


def _is_other(m: Column) -> Column:
    return m.startswith(ROLE_OPEN) & m.endswith(ROLE_CLOSE)


def _inside(m: Column, before: int | Column, after: int) -> Column:
    before = F.lit(before) if isinstance(before, int) else before
    return F.substring(m, before + 1, F.length(m) - before - after)


def parse(formatted: Column) -> Column:
    """Turns of a formatted string: the deterministic parser of the template."""

    def one(m: Column) -> Column:
        role = F.substring_index(_inside(m, len(ROLE_OPEN), 0), "]", 1)
        return (
            F.when(_is_user(m), F.struct(F.lit("user").alias("role"), unescape(_inside(m, len(USER_OPEN), len(USER_CLOSE))).alias("text")))
            .when(_is_other(m), F.struct(unescape(role).alias("role"), unescape(_inside(m, F.length(role) + len(ROLE_OPEN) + len(ROLE_MIDDLE), len(ROLE_CLOSE))).alias("text")))
            .otherwise(F.struct(F.lit("assistant").alias("role"), unescape(_inside(m, len(BOT_OPEN), len(BOT_CLOSE))).alias("text")))
        )

    return F.transform(pieces(formatted), one).cast(TURNS)


def loss_spans(formatted: Column) -> Column:
    """Half-open spans, in code points of the formatted string, of what assistants say (without their marks)."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,stop:int>>)").alias("spans"))

    def step(state: Column, m: Column) -> Column:
        span = F.struct((state["at"] + len(BOT_OPEN)).alias("start"), (state["at"] + F.length(m) - len(BOT_CLOSE)).alias("stop"))
        spans = F.when(_is_user(m) | _is_other(m), state["spans"]).otherwise(F.array_append(state["spans"], span))
        return F.struct((state["at"] + F.length(m)).alias("at"), spans.alias("spans"))

    return F.aggregate(pieces(formatted), start, step, lambda s: s["spans"])


def format_chats(rows: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, formatted, level, spans (the loss mask).

    rows: conv_id, turn, role, text. Rendering takes the lowest level whose parse equals the source.
    """
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    chats = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    chats = chats.select("conv_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    turns = F.col("turns")
    trip = lambda level: parse(render(turns, level)) == turns.cast(TURNS)
    level = F.when(trip(0), 0).when(trip(1), 1).otherwise(2)
    out = chats.withColumn("level", level)
    at = F.col("level")
    text = F.when(at == 0, render(turns, 0)).when(at == 1, render(turns, 1)).otherwise(render(turns, 2))
    return out.select("conv_id", text.alias("formatted"), "level").withColumn("spans", loss_spans(F.col("formatted")))


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted strings recovers: turns by the parser, loss text by the spans."""
    f = F.col("formatted")
    masked = F.transform("spans", lambda s: unescape(F.substring(f, s["start"] + 1, s["stop"] - s["start"])))
    read = formatted.select("conv_id", "formatted", parse(f).alias("turns"), F.array_join(masked, "").alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
