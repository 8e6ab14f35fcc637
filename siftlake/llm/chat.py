"""Chat formatting: a role automaton, a declarative template, segments with loss flags.

Built-in SQL functions only.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from types import MappingProxyType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are marked, what is escaped in texts, which roles bear loss, which turn orders are valid.

    A turn is ``open + label + sep + text + close``. In texts the escape
    character and each control string become the escape character and one
    letter, so no control string survives inside a text.
    """

    open: str = "### "
    sep: str = ": "
    close: str = "</turn>\n"
    labels: Mapping[str, str] = field(default_factory=lambda: MappingProxyType({"system": "System", "user": "User", "assistant": "Assistant"}))
    escape: str = "\\"
    controls: Mapping[str, str] = field(default_factory=lambda: MappingProxyType({"###": "h", "</turn>": "t"}))
    loss_roles: tuple[str, ...] = ("assistant",)
    transitions: Mapping[str, tuple[str, ...]] = field(
        default_factory=lambda: MappingProxyType({"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    )

    def escaped(self, text: Column) -> Column:
        out = F.replace(text, F.lit(self.escape), F.lit(self.escape * 2))
        for control, letter in self.controls.items():
            out = F.replace(out, F.lit(control), F.lit(self.escape + letter))
        return out

    def plain(self, text: Column) -> Column:
        """Undo :meth:`escaped`; doubled escape characters are cut out first, so letters after them stay."""

        def piece(p: Column) -> Column:
            for control, letter in self.controls.items():
                p = F.replace(p, F.lit(self.escape + letter), F.lit(control))
            return p

        return F.array_join(F.transform(F.split(text, re.escape(self.escape * 2), -1), piece), self.escape)

    def label(self, role: Column) -> Column:
        """Known roles by label; any other as ``role=`` and its escaped name, in which the separator is escaped too."""
        out = F.concat(F.lit("role="), F.replace(self.escaped(role), F.lit(":"), F.lit(self.escape + "c")))
        for name, shown in self.labels.items():
            out = F.when(role == name, F.lit(shown)).otherwise(out)
        return out

    def role(self, label: Column) -> Column:
        raw = F.substring(label, 6, 2**31 - 1)
        parts = F.transform(F.split(raw, re.escape(self.escape * 2), -1), lambda p: F.replace(p, F.lit(self.escape + "c"), F.lit(":")))
        out = self.plain(F.array_join(parts, self.escape * 2))
        for name, shown in self.labels.items():
            out = F.when(label == shown, F.lit(name)).otherwise(out)
        return out


def format_conversations(
    turns: DataFrame, template: Template = Template(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, valid, first_invalid, segments, formatted``.

    Rows go by turn; rows of the same turn by role, then text. Null roles
    and texts are empty texts, a null id is a conversation of its own, and
    extra columns are ignored. ``valid`` tells whether the automaton accepts
    the order of roles, ``first_invalid`` the zero-based position where it
    first does not; invalid conversations are formatted all the same.
    ``segments`` is ``array<struct<text, loss>>`` and ``formatted`` their
    concatenation. One conversation is formatted in one row, so its size
    must fit a row.
    """
    row = F.struct(
        F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
    )
    got = turns.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    allowed = F.create_map(*[F.lit(x) for k, v in template.transitions.items() for x in (k, "\x00" + "\x00".join(v) + "\x00")])
    step = lambda s, r: F.when(s["bad"] >= 0, s).otherwise(
        F.when(
            F.coalesce(F.contains(F.element_at(allowed, s["state"]), F.concat(F.lit("\x00"), r["role"], F.lit("\x00"))), F.lit(False)),
            F.struct(r["role"].alias("state"), (s["at"] + 1).alias("at"), s["bad"].alias("bad")),
        ).otherwise(F.struct(s["state"].alias("state"), s["at"].alias("at"), s["at"].alias("bad")))
    )
    state = F.aggregate("turns", F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("bad")), step)

    def segments(t: Column) -> Column:
        part = lambda c, loss: F.struct(c.alias("text"), loss.alias("loss"))
        return F.array(
            part(F.concat(F.lit(template.open), template.label(t["role"]), F.lit(template.sep)), F.lit(False)),
            part(template.escaped(t["text"]), t["role"].isin(*template.loss_roles)),
            part(F.lit(template.close), F.lit(False)),
        )

    out = got.select("conv_id", F.size("turns").cast("long").alias("n_turns"), state["bad"].alias("bad"), F.flatten(F.transform("turns", segments)).alias("segments"))
    return out.select(
        "conv_id",
        "n_turns",
        (F.col("bad") < 0).alias("valid"),
        F.when(F.col("bad") >= 0, F.col("bad")).alias("first_invalid"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """``array<struct<role, text>>`` from a formatted conversation."""
    pieces = F.split(formatted, re.escape(template.close), -1)
    bodies = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(p: Column) -> Column:
        cut = F.instr(p, F.lit(template.sep))
        label = F.substring(p, F.lit(len(template.open) + 1), cut - 1 - len(template.open))
        return F.struct(template.role(label).alias("role"), template.plain(F.substring(p, cut + len(template.sep), F.lit(2**31 - 1))).alias("text"))

    return F.transform(bodies, turn)


def loss_text(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.plain(s["text"])), "")
