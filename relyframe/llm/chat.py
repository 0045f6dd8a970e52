"""Chat formatting: a state machine over roles, a declarative template, loss flags by segment.

Everything is DataFrame functions. Each conversation is one row: its turns
in order (by turn, then role and text, so ties have one order), folded
through the state machine, and written as segments {text, loss}. Inside
texts and roles the control strings can't occur: the escape character, "<"
(with which every control string begins) and, in roles, the line feed are
replaced, and :func:`turns_of` puts them back.

Null text or role is empty text; a null conv_id is a conversation of its
own key; rows without a turn number come first. A role that the template
doesn't know is written without loss and makes the conversation invalid. An
empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What is written around turns, who bears loss, and which turn may follow which."""

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: state -> {role: next state}
    moves: dict = field(default_factory=lambda: {
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    })
    final: tuple[str, ...] = ("assistant",)


TEMPLATE = Template()
#: What is replaced in texts, in this order; undone in the opposite order.
ESCAPES = (("\\", "\\b"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "\\n"))


def escape(c: Column, table=ESCAPES) -> Column:
    for plain, safe in table:
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def unescape(c: Column, table=ESCAPES) -> Column:
    for plain, safe in reversed(table):
        c = F.replace(c, F.lit(safe), F.lit(plain))
    return c


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def format_conversations(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, segments array<{text, loss}>, valid, bad_turn (place of the first turn out of order, or null).

    One shuffle on conv_id. Escaping and segments are made before it, row by
    row. A conversation is one row of the result, so the largest one has to
    fit into a row.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    never = F.lit(False)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).alias("key"),
        F.array(
            _segment(F.concat(F.lit(template.open), escape(role, ROLE_ESCAPES), F.lit(template.after_role)), never),
            _segment(escape(text), role.isin(*template.loss_roles)),
            _segment(F.lit(template.close), never),
        ).alias("segments"))
    rows = rows.select("conv_id", F.struct(F.col("key.turn").alias("turn"), F.col("key.role").alias("role"),
                                           F.col("segments").alias("segments")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    moves = F.create_map(*[F.lit(x) for s, by in template.moves.items() for r, to in by.items()
                           for x in (f"{s}\n{r}", to)])
    def move(at: Column, role: Column) -> Column:
        return F.coalesce(F.try_element_at(moves, F.concat(at, F.lit("\n"), role)), F.lit(""))  # "": rejected, for good

    state = F.aggregate(
        "turns",
        F.struct(F.lit(template.start).alias("at"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad")),
        lambda s, t: F.struct(
            move(s["at"], t["role"]).alias("at"),
            (s["n"] + 1).alias("n"),
            F.when(s["bad"].isNotNull(), s["bad"]).when(move(s["at"], t["role"]) == "", s["n"]).alias("bad")))
    return whole.select(
        "conv_id", F.flatten(F.transform("turns", lambda t: t["segments"])).alias("segments"), state.alias("s"),
    ).select("conv_id", "segments",
             (F.col("s.bad").isNull() & F.col("s.at").isin(*template.final)).alias("valid"),
             F.col("s.bad").alias("bad_turn"))


def formatted(segments: Column) -> Column:
    """The one string that a model sees."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def turns_of(text: Column, template: Template = TEMPLATE) -> Column:
    """Read a formatted string back: array<{role, text}>, unescaped."""
    parts = F.split(text, _quoted(template.close))
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)  # after the last close there is nothing

    def turn(p: Column) -> Column:
        body = F.substring(p, F.lit(len(template.open) + 1), F.length(p))
        head = F.substring_index(body, template.after_role, 1)
        rest = F.substring(body, F.length(head) + F.lit(len(template.after_role) + 1), F.length(body))
        return F.struct(unescape(head, ROLE_ESCAPES).alias("role"), unescape(rest).alias("text"))

    return F.transform(parts, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def _quoted(s: str) -> str:
    return "".join("\\" + ch if ch in "\\.[]{}()*+-?^$|<>" else ch for ch in s)


def digests(formatted_rows: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """What the formatted rows hold, read back from their strings and flags."""
    back = formatted_rows.select(
        "conv_id", "valid", F.col("bad_turn").cast("long").alias("bad_turn"), formatted(F.col("segments")).alias("out"),
        loss_text(F.col("segments")).alias("loss"))
    back = back.withColumn("turns", turns_of(F.col("out"), template))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))),
                            "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("out").cast("long").alias("formatted_chars"), "valid", "bad_turn")
