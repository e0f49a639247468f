"""Chat formatting: a state machine over roles, and text segments with loss flags from a template.

Method. A template declares, as data, how each role's turns open and close, which roles carry loss
and which role may follow which. Every turn becomes three segments: opening mark, escaped text, closing
mark; only texts of roles with loss are flagged. Inside texts every character that can begin a mark,
and the escape itself, is followed by the escape, so no text can hold a mark and the texts can be
read back. The machine's state is the role last seen; its walk over a conversation's roles says
whether the turn order is valid and where it first fails. Everything is native expressions.

Defined results. A null text is empty, a null role is the empty role. A role the template does not know
is formatted under its name, without loss, and makes the order invalid. Turns are taken by turn number
(nulls first), then role and text, so ties and repeated rows have one order; each is a turn of its own. A
conversation is one row of the result, so its formatted text must fit a row. No rows give no rows;
other columns are not looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column

START, INVALID = "", "\0invalid"


@dataclass(frozen=True)
class Role:
    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role, the roles that may follow each role, and the roles a conversation may end with."""

    roles: dict[str, Role]
    follows: dict[str, tuple[str, ...]]
    ends: tuple[str, ...]
    named: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[END]")
    escape: str = "\\"
    leads: str = field(init=False)

    def __post_init__(self):
        marks = [m for r in self.roles.values() for m in (r.opening, r.closing)] + list(self.named)
        if len({r.opening for r in self.roles.values()} | {self.named[0]}) <= len(self.roles):
            raise ValueError("opening marks must differ")
        if any(len(m) < 2 or m[1] == self.escape or m[0] == self.escape for m in marks):
            raise ValueError("a mark has two characters at least, and neither of the first two is the escape")
        object.__setattr__(self, "leads", "".join(sorted({m[0] for m in marks})) + self.escape)


TEMPLATE = Template(
    roles={
        "system": Role("<<SYS>>", "<</SYS>>"),
        "user": Role("[INST]", "[/INST]"),
        "assistant": Role("<s>", "</s>", loss=True),
    },
    follows={START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ends=("assistant",),
)


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c for c in chars) + "]"


def escaped(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, f"({_class(template.leads)})", "$1" + template.escape.replace("\\", "\\\\"))


def unescaped(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, f"({_class(template.leads)}){re.escape(template.escape)}", "$1")


def _segment(text: Column, loss: bool | Column) -> Column:
    return F.struct(text.alias("text"), (F.lit(loss) if isinstance(loss, bool) else loss).alias("loss"))


def _turn_segments(role: Column, text: Column, template: Template) -> Column:
    middle, last = template.named[1:]
    named = F.concat(F.lit(template.named[0]), escaped(role, template), F.lit(middle))
    opening, closing, loss = named, F.lit(last), F.lit(False)
    for name, r in template.roles.items():
        opening = F.when(role == name, F.lit(r.opening)).otherwise(opening)
        closing = F.when(role == name, F.lit(r.closing)).otherwise(closing)
        loss = F.when(role == name, F.lit(r.loss)).otherwise(loss)
    return F.array(
        _segment(opening, False),
        _segment(escaped(text, template), loss),
        _segment(closing, False),
    )


def turn_order(roles: Column, template: Template) -> Column:
    """Struct of ``state`` (the last role, or a mark of failure) and ``failed_at`` (first turn out of order)."""
    allowed = F.array(*[F.concat_ws("\0", F.lit(a), F.lit(b)) for a, bs in template.follows.items() for b in bs])
    start = F.struct(F.lit(START).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("failed_at"))

    def step(state: Column, role: Column) -> Column:
        fits = (state["state"] != INVALID) & F.array_contains(allowed, F.concat_ws("\0", state["state"], role))
        return F.struct(
            F.when(fits, role).otherwise(F.lit(INVALID)).alias("state"),
            (state["at"] + 1).alias("at"),
            F.coalesce(state["failed_at"], F.when(~fits, state["at"])).alias("failed_at"),
        )

    return F.aggregate(roles, start, step)


def format_chats(
    rows: DataFrame,
    template: Template = TEMPLATE,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """conv_id, segments array<struct<text, loss>>, valid, failed_at (turn that is out of order, from 0)."""
    empty = F.lit("")
    turns = rows.select(
        column(conv_col).alias("conv_id"),
        F.struct(
            column(turn_col).alias("turn"),
            F.coalesce(column(role_col), empty).alias("role"),
            F.coalesce(column(text_col), empty).alias("text"),
        ).alias("turn"),
    )
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    walked = grouped.select(
        "conv_id",
        F.flatten(F.transform("turns", lambda t: _turn_segments(t["role"], t["text"], template))).alias("segments"),
        turn_order(F.transform("turns", lambda t: t["role"]), template).alias("order"),
    )
    return walked.select(
        "conv_id", "segments", F.col("order.state").isin(*template.ends).alias("valid"), "order.failed_at"
    )


def formatted_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: Column, template: Template = TEMPLATE) -> Column:
    """The texts under the loss mask, unescaped, one after the other."""
    flagged = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(flagged, lambda s: unescaped(s["text"], template)), "")


def read_turns(formatted: Column, template: Template = TEMPLATE) -> Column:
    """array<struct<role, text>> read back from formatted text alone."""
    marks = {name: (r.opening, r.closing) for name, r in template.roles.items()}
    first, middle, last = template.named
    openings = [m[0] for m in marks.values()] + [first]
    pieces = F.filter(
        F.split(formatted, "(?=" + "|".join(re.escape(m) for m in openings) + ")"), lambda p: p != F.lit("")
    )

    def inner(piece: Column, opening: str, closing: str) -> Column:
        return piece.substr(F.lit(len(opening) + 1), F.length(piece) - len(opening) - len(closing))

    def parsed(piece: Column) -> Column:
        body = inner(piece, first, last)
        cut = F.instr(body, middle)
        out = F.struct(
            unescaped(body.substr(F.lit(1), cut - 1), template).alias("role"),
            unescaped(body.substr(cut + len(middle), F.length(body)), template).alias("text"),
        )
        for name, (opening, closing) in marks.items():
            known = F.struct(F.lit(name).alias("role"), unescaped(inner(piece, opening, closing), template).alias("text"))
            out = F.when(F.startswith(piece, F.lit(opening)), known).otherwise(out)
        return out

    return F.transform(pieces, parsed)


def chat_digests(chats: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid, all read from the output."""
    read = chats.select(
        "conv_id",
        "valid",
        formatted_text(F.col("segments")).alias("formatted"),
        loss_text(F.col("segments"), template).alias("loss"),
    ).withColumn("turns", read_turns(F.col("formatted"), template))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
