"""Chat formatting: a finite-state machine over roles, and text segments with a loss flag each.

A template says in data alone what stands before and after a turn of each role, which roles' texts are
under the loss, and which role may follow which. Texts are escaped so that no control string can appear in
them: the escape sign, `<` and `#` become the escape sign and a letter, which `unescape` undoes. Rows are
put together by conversation with DataFrame functions only; one conversation's text must fit in a row, as its
digest needs it in order.

Rows are ordered by turn, then role, then text (nulls first), so ties and repeated rows have one order. A
null role or text is empty; a null conversation id is a conversation of its own. Roles that the template
doesn't know are formatted by its default and make the order invalid. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Escape sign and what stands for the three signs that control strings are made of; `:` ends a role's name.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


@dataclass(frozen=True)
class Template:
    """Declares a format. before: holds {role}; after must hold one of the escaped signs."""

    before: str = "### {role}: "
    after: str = " </turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state (the role before, or "start") to the roles that may follow
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    final: tuple[str, ...] = ("assistant",)


def escape(text: Column, rules=ESCAPES) -> Column:
    for sign, code in rules:
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def unescape(text: Column, rules=ESCAPES) -> Column:
    for sign, code in reversed(rules):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def format_conversations(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, segments (text, loss) in order, formatted text, and whether the roles' order is valid."""
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    head, tail = template.before.split("{role}")

    def segments(t: Column) -> Column:
        loss = t["role"].isin(*template.loss_roles)
        piece = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
        return F.array(
            piece(F.concat(F.lit(head), escape(t["role"], ROLE_ESCAPES), F.lit(tail)), F.lit(False)),
            piece(escape(t["text"]), loss),
            piece(F.lit(template.after), F.lit(False)),
        )

    allowed = F.create_map(*[F.lit(x) for a, bs in template.follows.items() for b in bs for x in (f"{a}\n{b}", b)])
    step = lambda state, t: F.coalesce(F.try_element_at(allowed, F.concat(state, F.lit("\n"), t["role"])), F.lit("invalid"))
    grouped = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.select(
        "conv_id",
        F.flatten(F.transform("turns", segments)).alias("segments"),
        F.aggregate("turns", F.lit("start"), step).isin(*template.final).alias("valid_order"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of what the formatted text and the loss flags say."""
    head, tail = template.before.split("{role}")
    parts = F.split(F.col("formatted"), "\\Q" + template.after + "\\E", -1)
    turns = F.slice(parts, 1, F.size(parts) - 1)

    def said(t: Column) -> Column:
        cut = F.instr(t, tail)
        role = t.substr(F.lit(len(head) + 1), cut - 1 - len(head))
        text = t.substr(cut + len(tail), F.length(t))
        return F.concat(unescape(role, ROLE_ESCAPES), F.lit("\n"), unescape(text), F.lit("\n"))

    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return (
        formatted.withColumn("turns", turns)
        .withColumn("loss_text", loss)
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform("turns", said), ""), 256).alias("turns_sha256"),
            F.length("loss_text").cast("long").alias("loss_chars"),
            F.sha2("loss_text", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
            "valid_order",
        )
    )
