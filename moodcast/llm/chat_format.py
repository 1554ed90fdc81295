"""Chat formatting: a finite-state machine over roles and a declarative template.

A template gives each role its opening and closing mark and whether its text
bears loss. The rows of a conversation are put in turn order, a finite-state
machine checks the order of the roles, and the conversation becomes text
segments with a loss flag each; their concatenation is the formatted text.

Control strings inside texts are escaped by a backslash after their first
character (one more where backslashes already stand there), so the formatted
text holds control strings only as marks and every text can be read back
exactly; texts without such strings are unchanged.

Defined cases: rows are ordered by turn, ties by role and then text, nulls
first; a null text is empty; a null or unknown role is formatted with the
general mark and its name, bears no loss, and is an error of order; a null
conversation id is one conversation; repeated rows are turns of their own; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    role: str
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks of the roles, the order they may come in, and the marks of any other role.

    Marks hold no white space; a space stands between a mark and the text. No
    mark may contain another one, or end as another begins.
    """

    turns: tuple[Turn, ...] = (
        Turn("system", "<<SYS>>", "<</SYS>>"),
        Turn("user", "[INST]", "[/INST]"),
        Turn("assistant", "<s>", "</s>", loss=True),
    )
    other: tuple[str, str] = ("<<ROLE>>", "<</ROLE>>")
    after: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})

    def __post_init__(self) -> None:
        marks = self.marks()
        for a in marks:
            if re.search(r"\s|\\", a) or len(a) < 2:
                raise ValueError(f"mark {a!r}")
            for b in marks:
                if (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b)) if a[-k:] != a):
                    raise ValueError(f"marks {a!r} and {b!r} overlap")

    def marks(self) -> list[str]:
        return sorted({m for t in self.turns for m in (t.open, t.close)} | set(self.other))

    def patterns(self) -> list[tuple[str, str]]:
        """For each first character of the marks: it, and a pattern of what follows it."""
        firsts = sorted({m[0] for m in self.marks()})
        return [(c, "(?:" + "|".join(_quote(m[1:]) for m in self.marks() if m[0] == c) + ")") for c in firsts]


DEFAULT = Template()


def _quote(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9/ ])", r"\\\1", s)


def escape(text: Column, template: Template = DEFAULT) -> Column:
    for c, rest in template.patterns():
        text = F.regexp_replace(text, F.lit(rf"{_quote(c)}(\\*{rest})"), F.lit(rf"{_quote(c)}\\$1"))
    return text


def unescape(text: Column, template: Template = DEFAULT) -> Column:
    for c, rest in template.patterns():
        text = F.regexp_replace(text, F.lit(rf"{_quote(c)}\\(\\*{rest})"), F.lit(f"{_quote(c)}$1"))
    return text


def _by_role(role: Column, template: Template, of, other: Column) -> Column:
    out = F.when(F.lit(False), other)
    for t in template.turns:
        out = out.when(role == t.role, of(t))
    return out.otherwise(other)


def format_conversations(rows: DataFrame, template: Template = DEFAULT, id_col: str = "conv_id",
                         turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation.

    Columns: ``id_col``, ``segments`` (array of text and loss), ``formatted``,
    ``valid`` (the order of roles is allowed), ``error_at`` (position of the
    first turn that is not, else null), ``complete`` (valid and ends with a
    role that bears loss).
    """
    name = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    turns = rows.select(
        F.col(id_col).alias("__id"),
        F.struct(F.col(turn_col).alias("turn"), name.alias("role"), escape(text, template).alias("text")).alias("t"))
    grouped = turns.groupBy("__id").agg(F.sort_array(F.collect_list("t")).alias("t"))

    allowed = F.array(*[F.lit(f"{a}>{b}") for a, bs in template.after.items() for b in bs])

    def step(s: Column, t: Column) -> Column:
        ok = s["bad"].isNull() & F.array_contains(allowed, F.concat(s["state"], F.lit(">"), t["role"]))
        return F.struct(t["role"].alias("state"), (s["n"] + 1).alias("n"),
                        F.when(ok, F.lit(None).cast("int")).otherwise(F.coalesce(s["bad"], s["n"])).alias("bad"))

    machine = F.aggregate("t", F.struct(F.lit("").alias("state"), F.lit(0).alias("n"),
                                        F.lit(None).cast("int").alias("bad")), step)

    def marked(t: Column) -> Column:
        start = _by_role(t["role"], template, lambda x: F.lit(f"{x.open} "),
                         F.concat(F.lit(f"{template.other[0]} "), F.url_encode(t["role"]), F.lit(": ")))
        end = _by_role(t["role"], template, lambda x: F.lit(f" {x.close}"), F.lit(f" {template.other[1]}"))
        loss = _by_role(t["role"], template, lambda x: F.lit(x.loss), F.lit(False))
        return F.array(*[F.struct(p.alias("text"), flag.alias("loss"))
                         for p, flag in ((start, F.lit(False)), (t["text"], loss), (end, F.lit(False)))])

    out = grouped.select("__id", F.flatten(F.transform("t", marked)).alias("segments"), machine.alias("m"))
    bears = F.array(*[F.lit(t.role) for t in template.turns if t.loss])
    return out.select(
        F.col("__id").alias(id_col), "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.col("m.bad").isNull().alias("valid"), F.col("m.bad").alias("error_at"),
        (F.col("m.bad").isNull() & F.array_contains(bears, F.col("m.state"))).alias("complete"))


def read_turns(formatted: Column, template: Template = DEFAULT) -> Column:
    """The turns of a formatted text: array of role and (unescaped) text."""
    pairs = [(t.open, t.close) for t in template.turns] + [template.other]
    each = "(?s)" + "|".join(f"{_quote(a)} .*? {_quote(z)}" for a, z in pairs)
    found = F.regexp_extract_all(formatted, F.lit(each), F.lit(0))

    def turn(m: Column) -> Column:
        head = F.regexp_extract(m, rf"(?s)^{_quote(template.other[0])} [^:]*: ", 0)
        role = F.url_decode(F.regexp_extract(m, rf"(?s)^{_quote(template.other[0])} ([^:]*): ", 1))
        inner = m.substr(F.length(head) + 1, F.length(m) - F.length(head) - len(template.other[1]) - 1)
        for t in template.turns:
            mine = F.startswith(m, F.lit(f"{t.open} "))
            role = F.when(mine, F.lit(t.role)).otherwise(role)
            inner = F.when(mine, m.substr(F.lit(len(t.open) + 2), F.length(m) - len(t.open) - len(t.close) - 2)).otherwise(inner)
        return F.struct(role.alias("role"), unescape(inner, template).alias("text"))

    return F.transform(found, turn)


def loss_text(segments: Column, template: Template = DEFAULT) -> Column:
    """The texts under the loss mask, unescaped, joined without anything between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]),
                                    lambda s: unescape(s["text"], template)), "")
