"""Chat formatting by a finite-state machine over roles, in DataFrame functions only.

A template is data: how a turn begins and ends, which roles are learnt from, and which
role may follow which. A conversation becomes an array of segments (text, loss), whose
texts joined are the training string. Control strings within texts are escaped: after
their first character one backslash more is put than stands there, so that an escaped
string is never a control string, and reading back takes one backslash away.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENTS = "array<struct<text:string,loss:boolean>>"


@dataclass(frozen=True)
class Template:
    """begin, role, separator, text, end: one turn. moves: state -> {role: next state}."""

    begin: str = "<|turn|>"
    separator: str = "\n"
    end: str = "<|end|>\n"
    learnt: tuple[str, ...] = ("assistant",)
    #: Further control strings that texts must not carry unescaped.
    guarded: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    start: str = "start"
    moves: dict = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        if self.separator != "\n":
            raise ValueError("roles escape the line feed; the separator must be one")
        for x in self.controls:
            if len(x) < 2 or x[1] == "\\":
                raise ValueError("a control string needs two characters, the second not a backslash")

    @property
    def controls(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((self.begin, self.end.strip(), *self.guarded)))

    @property
    def pattern(self) -> str:
        """Group 1: the first character, 2: backslashes, 3: the rest."""
        firsts = "".join(re.escape(c) for c in sorted({x[0] for x in self.controls}))
        return f"([{firsts}])(\\\\*)({'|'.join(re.escape(x[1:]) for x in self.controls)})"


def escaped(text: Column, template: Template) -> Column:
    """Control strings made harmless; reversible by unescaped()."""
    return F.regexp_replace(text, template.pattern, r"$1\\$2$3")


def unescaped(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, template.pattern.replace("(\\\\*)", "\\\\(\\\\*)"), "$1$2$3")


def _role_out(role: Column, template: Template) -> Column:
    """A role as it stands in a turn's head: without line feeds and control strings."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), template)


def _role_in(role: Column, template: Template) -> Column:
    pieces = F.split(unescaped(role, template), r"\\\\")
    return F.array_join(F.transform(pieces, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def format_chats(rows: DataFrame, template: Template | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, n_turns, valid, segments, formatted.

    rows: one per turn, taken by turn (ties by role, then text; null turns first). Null
    texts and roles count as empty; a null id is a conversation of its own; repeated rows
    are turns. valid: the roles are a path of the template's machine that ends in a
    final state; a conversation that isn't valid is formatted all the same. Other columns
    are not read. One shuffle on the id; what a conversation holds is one row, as its
    output is.
    """
    t = template or Template()
    turn = F.struct(
        rows[turn_col].alias("turn"),
        F.coalesce(rows[role_col].cast("string"), F.lit("")).alias("role"),
        F.coalesce(rows[text_col].cast("string"), F.lit("")).alias("text"),
    )
    chats = rows.select(rows[id_col].alias("id"), turn.alias("x")).groupBy("id").agg(F.sort_array(F.collect_list("x")).alias("turns"))
    steps = F.create_map(*[F.lit(x) for s, to in t.moves.items() for r, n in to.items() for x in (f"{s}\n{r}", n)])
    state = F.aggregate("turns", F.lit(t.start), lambda s, x: F.coalesce(F.element_at(steps, F.concat(s, F.lit("\n"), x["role"])), F.lit("")))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                F.struct(F.concat(F.lit(t.begin), _role_out(x["role"], t), F.lit(t.separator)).alias("text"), F.lit(False).alias("loss")),
                F.struct(escaped(x["text"], t).alias("text"), x["role"].isin(*t.learnt).alias("loss")),
                F.struct(F.lit(t.end).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    out = chats.select("id", F.size("turns").cast("long").alias("n_turns"), state.isin(*t.final).alias("valid"), segments.alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")).withColumnRenamed("id", id_col)


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """The (role, text) pairs of a formatted conversation, as they were before formatting."""
    t = template or Template()
    parts = F.filter(F.split(formatted, re.escape(t.begin)), lambda p: p != "")
    cut = F.lit(len(t.end))

    def turn(p: Column) -> Column:
        head = F.instr(p, F.lit("\n"))
        return F.struct(
            _role_in(F.substring(p, F.lit(1), head - 1), t).alias("role"),
            unescaped(F.substring(p, head + 1, F.length(p) - head - cut), t).alias("text"),
        )

    return F.transform(parts, turn)


def learnt_text(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped, in order."""
    t = template or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], t)), "")
