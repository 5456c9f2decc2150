"""Chat formatting: a state machine over roles, and a declarative template that marks turns (DataFrame functions only).

A conversation's rows, in the order of their turns, are numbered and put together in chunks of ``chunk`` turns, so that a
conversation of any length is spread over tasks.  In a chunk the machine runs over the roles; the state it enters a chunk
with is the one that the last role of the chunk before leaves it in, whatever came earlier.  A turn that the machine has
no transition for is illegal; the machine goes on from that turn's role, so that later faults are found as well.

A turn becomes three segments of the template, each with a loss flag: what opens it, its text, what closes it.  In a text
the escape sign is doubled, and the first sign of every control string gets one in front; in a role each of them becomes
the sign and a letter.  So a closing mark is never found inside a turn, and :func:`read_back` gets every turn back.

Defined results: a null text or role is an empty one; null turns come first, equal turns are ordered by role, then text;
rows with a null conversation id are a conversation; repeated rows are turns like any other; an empty table gives an
empty result.  Other columns of the input are not carried.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linesift.llm.stage import numbered, ordered, stage

#: Turns in one row at most.
CHUNK = 64
SEGMENT = "array<struct<text: string, loss: boolean>>"


@dataclass(frozen=True)
class Template:
    """Marks, roles whose texts bear loss, and the machine: the roles that may follow a role ('' is the start)."""

    open: str = "### "
    after_role: str = ": "
    close: str = " </turn>\n"
    escape: str = "\\"
    controls: tuple[str, ...] = ("###", "</turn>")
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        # What the escaping rests on: a closing mark holds a control string behind another sign, which no text can do.
        held = [c for c in self.controls if c in self.close and not self.close.startswith(c)]
        if not held or len(self.escape) != 1 or any(self.escape in m for m in (self.open, self.after_role, self.close, *self.controls)):
            raise ValueError("the closing mark must hold a control string behind its first sign, and no mark the escape sign")
        if any(self.close[self.close.index(c) - 1] == self.escape for c in held):
            raise ValueError("the control string in the closing mark must not stand behind the escape sign")


TEMPLATE = Template()


def _quoted(s: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in s)


def escaped(text: Column, t: Template) -> Column:
    """The escape sign, and the first sign of every control string, with an escape sign in front."""
    heads = "|".join(f"{_quoted(c[0])}(?={_quoted(c[1:])})" for c in t.controls)
    return F.regexp_replace(text, f"({_quoted(t.escape)}|{heads})", re.sub(r"([\\$])", r"\\\1", t.escape) + "$1")


def unescaped(text: Column, t: Template) -> Column:
    return F.regexp_replace(text, f"(?s){_quoted(t.escape)}(.)", "$1")


def _role_signs(t: Template) -> list[str]:
    return list(dict.fromkeys(t.escape + "".join(sorted({t.after_role[0], *(c[0] for c in t.controls)}))))


def escaped_role(role: Column, t: Template) -> Column:
    """The escape sign, and each sign that a mark can start with, as the escape sign and a letter."""
    for i, sign in enumerate(_role_signs(t)):
        role = F.replace(role, F.lit(sign), F.lit(t.escape + chr(97 + i)))
    return role


def unescaped_role(role: Column, t: Template) -> Column:
    for i, sign in reversed(list(enumerate(_role_signs(t)))):
        role = F.replace(role, F.lit(t.escape + chr(97 + i)), F.lit(sign))
    return role


def states(roles: Column, before: Column, t: Template) -> Column:
    """Per role, whether the machine has a transition for it from the role before (``before`` for the first one)."""
    previous = F.concat(F.array(before), F.slice(roles, 1, F.greatest(F.size(roles) - 1, F.lit(0))))
    arcs = [F.concat(F.lit(a), F.lit("\0"), F.lit(b)) for a, bs in t.follows.items() for b in bs]
    return F.zip_with(previous, roles, lambda a, b: F.array_contains(F.array(*arcs), F.concat(a, F.lit("\0"), b)))


def chunks(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``conv_id, chunk, turns (array of role and text), before``: up to ``chunk`` turns each, in order."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ranked = numbered(ordered(rows, ["conv_id", "turn", "role", "text"], "chat-turns"), ["conv_id"])
    ranked = ranked.withColumn("chunk", F.call_function("div", F.col("_rank"), F.lit(chunk)))
    grouped = ranked.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("_rank", "role", "text"))).alias("turns"))
    grouped = stage(grouped, "chat-chunks")
    # Only the last roles of chunks that another one follows are sent on.
    last = F.element_at("turns", -1)["role"]
    tails = grouped.where(F.size("turns") == chunk).select(F.col("conv_id").alias("_conv"), (F.col("chunk") + 1).alias("_chunk"), last.alias("_last"))
    on = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk"))
    return grouped.join(tails, on, "left").select("conv_id", "chunk", "turns", F.coalesce("_last", F.lit("")).alias("before"))


def format_chats(conversations: DataFrame, template: Template = TEMPLATE, chunk: int = CHUNK) -> DataFrame:
    """``conv_id, chunk, n_turns, segments (array of text and loss), legal (array of boolean), ends_final``.

    The texts of a chunk's segments one behind the other, and the chunks of a conversation in order, are its formatted
    text.  ``ends_final``: the chunk's last role may end a conversation.
    """
    t = template
    loss = lambda role: role.isin(list(t.loss_roles)) if t.loss_roles else F.lit(False)

    def segments(x: Column) -> Column:
        head = F.concat(F.lit(t.open), escaped_role(x["role"], t), F.lit(t.after_role))
        parts = ((head, F.lit(False)), (escaped(x["text"], t), loss(x["role"])), (F.lit(t.close), F.lit(False)))
        return F.array(*[F.struct(a.alias("text"), b.alias("loss")) for a, b in parts])

    roles = F.transform("turns", lambda x: x["role"])
    return chunks(conversations, chunk).select(
        "conv_id",
        "chunk",
        F.size("turns").alias("n_turns"),
        F.flatten(F.transform("turns", segments)).cast(SEGMENT).alias("segments"),
        states(roles, F.col("before"), t).alias("legal"),
        F.element_at("turns", -1)["role"].isin(list(t.final)).alias("ends_final"),
    )


def read_back(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """The columns of ``formatted`` with ``formatted`` (text), ``turns`` (role and text) parsed from it, ``loss_texts``."""
    t = template
    whole = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    parts = F.split("formatted", _quoted(t.close), -1)  # an empty piece is left behind the last closing mark
    head, mark = len(t.open), len(t.after_role)

    def turn(p: Column) -> Column:
        end = F.locate(t.after_role, p, head + 1) if isinstance(p, str) else F.call_function("locate", F.lit(t.after_role), p, F.lit(head + 1))
        role = p.substr(F.lit(head + 1), end - F.lit(head + 1))
        text = p.substr(end + F.lit(mark), F.length(p))
        return F.struct(unescaped_role(role, t).alias("role"), unescaped(text, t).alias("text"))

    out = formatted.withColumn("formatted", whole)
    out = out.withColumn("turns", F.transform(F.slice(parts, 1, F.size(parts) - 1), turn))
    return out.withColumn("loss_texts", F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], t)))


def digests(read: DataFrame) -> DataFrame:
    """Per conversation, of what was read back: counts and checksums over its chunks in order.

    A checksum is taken over one string, so here (and only here) the texts of a conversation meet in a row.
    """
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    rows = read.select("conv_id", "chunk", F.size("turns").cast("long").alias("n"), said.alias("said"), F.array_join("loss_texts", "").alias("lost"), F.length("formatted").cast("long").alias("size"), F.size(F.filter("legal", lambda x: ~x)).cast("long").alias("bad"), "ends_final")
    parts = F.array_sort(F.collect_list(F.struct("chunk", "said", "lost")))
    groups = rows.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), parts.alias("parts"), F.sum(F.length("lost")).cast("long").alias("loss_chars"), F.sum("size").alias("formatted_chars"), F.sum("bad").alias("illegal_turns"), F.max_by("ends_final", "chunk").alias("ends_final"))
    digest = lambda name: F.sha2(F.array_join(F.transform("parts", lambda x: x[name]), ""), 256)
    return groups.select("conv_id", "n_turns", digest("said").alias("turns_sha256"), "loss_chars", digest("lost").alias("loss_sha256"), "formatted_chars", "illegal_turns", "ends_final")
