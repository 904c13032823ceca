"""Chat formatting: a role automaton validates turn order, a template emits segments with loss flags.

A conversation is its rows in order of turn (null first, then role and text). Every turn gives three
segments: opening marks, the escaped text, closing marks; the loss flag is set on assistant texts alone.
The marks are the template's control strings. Inside texts a backslash is doubled and every control string
gets a backslash behind its first character, so no text contains a mark and unescaping restores it.

Defined results: null text is the empty text; a null role is kept as null; roles that the template does not
name are written out between general marks; a row without conv_id is a conversation of its own; repeated
rows are repeated turns; an empty table gives no rows. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Opening and closing marks by role; ``other``: marks before role and text of any other role, and behind."""

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple[str, str, str, str] = ("<<NONE>>", "<<ROLE>>", "<<TEXT>>", "<</TURN>>")
    loss_roles: tuple[str, ...] = ("assistant",)
    # Transitions of the role automaton: state -> {role: state}; state 0 starts.
    transitions: dict[int, dict[str, int]] = field(default_factory=lambda: {0: {"system": 1, "user": 2}, 1: {"user": 2}, 2: {"assistant": 3}, 3: {"user": 2}})
    accepting: tuple[int, ...] = (2, 3)

    @property
    def controls(self) -> list[str]:
        return [*(m for pair in self.marks.values() for m in pair), *self.other]


LLAMA = Template()


def escape(text, template: Template = LLAMA):
    """Double backslashes and break every control string; reversible by ``unescape``."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in template.controls:
        out = F.replace(out, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return out


def unescape(text):
    """Drop every backslash that stands before another character."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def valid_order(roles, template: Template = LLAMA):
    """Whether the role automaton accepts an array of roles."""

    def step(state, role):
        out = F.lit(-1)
        for a, by_role in template.transitions.items():
            for name, b in by_role.items():
                out = F.when((state == a) & (role == name), F.lit(b)).otherwise(out)
        return out

    return F.aggregate(roles, F.lit(0), step).isin(*template.accepting)


def _segments(turn, template: Template):
    """Segments of one turn (role, text): array of (text, loss)."""
    part = lambda text, loss=False: F.struct(text.alias("text"), F.lit(loss).alias("loss"))
    text = escape(F.coalesce(turn["text"], F.lit("")), template)
    none, named, before_text, end = map(F.lit, template.other)
    out = F.array(part(F.when(turn["role"].isNull(), none).otherwise(F.concat(named, escape(turn["role"], template), before_text))), part(text), part(end))
    for role, (a, b) in template.marks.items():
        out = F.when(turn["role"] == role, F.array(part(F.lit(a)), part(text, role in template.loss_roles), part(F.lit(b)))).otherwise(out)
    return out


def format_chats(rows: DataFrame, template: Template = LLAMA) -> DataFrame:
    """rows: conv_id, turn, role, text. One row for each conversation: conv_id, valid, segments, formatted."""
    own = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    turns = rows.select("conv_id", own.alias("own"), F.struct("turn", "role", "text").alias("t")).groupBy("conv_id", "own").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    segments = F.flatten(F.transform("turns", lambda t: _segments(t, template)))
    done = turns.select("conv_id", valid_order(F.transform("turns", lambda t: t["role"]), template).alias("valid"), segments.alias("segments"))
    return done.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse_chats(formatted, template: Template = LLAMA):
    """Turns (role, text) read back from a formatted text: array of structs, unescaped."""
    opens, closes = [a for a, _ in template.marks.values()], [b for _, b in template.marks.values()]
    none, named, before_text, end = template.other
    quote = lambda s: "".join(f"\\{c}" if not c.isalnum() else c for c in s)
    pattern = F.lit(f"(?s)({'|'.join(map(quote, [*opens, none, named]))})(.*?)({'|'.join(map(quote, [*closes, end]))})")
    pairs = F.arrays_zip(F.regexp_extract_all(formatted, pattern, F.lit(1)).alias("mark"), F.regexp_extract_all(formatted, pattern, F.lit(2)).alias("body"))

    def turn(p):
        role = F.when(p["mark"] == named, unescape(F.substring_index(p["body"], before_text, 1)))
        text = F.when(p["mark"] == named, F.substring_index(p["body"], before_text, -1)).otherwise(p["body"])
        for name, (a, _) in template.marks.items():
            role = F.when(p["mark"] == a, F.lit(name)).otherwise(role)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(pairs, turn)


def loss_text(segments):
    """All unescaped text under the loss mask, in order, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
